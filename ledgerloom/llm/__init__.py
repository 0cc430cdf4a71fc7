"""Training-data operators: ten scans, filters and encoders over large text tables."""
