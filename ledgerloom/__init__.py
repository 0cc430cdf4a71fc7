"""Analytics over temporal transaction ledgers, expressed as DataFrame transformations."""
