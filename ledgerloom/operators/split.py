"""Train, validation and test in order of time."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..errors import SplitError
from ..functions.columns import micros, require_columns
from .windows import exact_quantiles

log = logging.getLogger(__name__)
NAMES = ("train", "val", "test")


def boundaries(df: DataFrame, settings: Settings = DEFAULT) -> tuple[int, int]:
    """Epoch microseconds of the last train and the last validation moment (linear quantiles)."""
    cuts = exact_quantiles(df.select(micros("timestamp").alias("us")), "us", (settings.train_end, settings.val_end))
    if cuts[0] is None:
        raise SplitError("the ledger is empty")
    return int(cuts[0]), int(cuts[1])


def with_split(df: DataFrame, settings: Settings = DEFAULT, cuts: tuple[int, int] | None = None) -> DataFrame:
    train, val = cuts or boundaries(df, settings)
    us = micros("timestamp")
    return df.withColumn("split", F.when(us <= train, "train").when(us <= val, "val").otherwise("test"))


def two_way(df: DataFrame, share: float = 0.70) -> DataFrame:
    """Exploration's split: ``fit`` up to the quantile of the moments at ``share``, ``held_out`` after."""
    cut = exact_quantiles(df.select(micros("timestamp").alias("us")), "us", (share,))[0]
    if cut is None:
        raise SplitError("the ledger is empty")
    return df.withColumn("split", F.when(micros("timestamp") <= int(cut), "fit").otherwise("held_out"))


def training_rows(df: DataFrame, settings: Settings = DEFAULT, drop_burn_in: bool = True) -> DataFrame:
    """Without formats that never are positive, self-loops and, if asked, the burn-in."""
    require_columns(df, ("payment_format", "is_self_loop", "is_burn_in", settings.target), SplitError)
    keep = ~F.col("payment_format").isin(*settings.zero_positive_formats) & ~F.col("is_self_loop")
    return df.filter(keep & ~F.col("is_burn_in") if drop_burn_in else keep)


def split_summary(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    y, us = F.col(settings.target), micros("timestamp")
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum(y.cast("long")).alias("positives"), F.avg(y.cast("double")).alias("rate"), F.min(us).alias("start_us"), F.max(us).alias("end_us"))


def split_faults(df: DataFrame, settings: Settings = DEFAULT, few: int = 100) -> DataFrame:
    """What ``validate_splits`` looks at, as one row for each split there is: split, no_positive,
    few_positives, overlaps_next (its last moment is after the next one's first)."""
    found = split_summary(df, settings)
    order = F.array_position(F.array(*map(F.lit, NAMES)), F.col("split"))
    one = found.agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "split", "positives", "start_us", "end_us"))).alias("all"))  # three rows
    each = one.select(F.posexplode("all").alias("i", "s"), "all")
    following = F.try_element_at("all", F.col("i") + 2)["start_us"]
    return each.select("s.split", (F.coalesce("s.positives", F.lit(0)) == 0).alias("no_positive"), (F.coalesce("s.positives", F.lit(0)) < few).alias("few_positives"), F.coalesce(F.col("s.end_us") > following, F.lit(False)).alias("overlaps_next"))


def validate_splits(df: DataFrame, settings: Settings = DEFAULT, few: int = 100) -> dict[str, dict]:
    """The summary by split; an error if one is empty, has no positive or overlaps the next."""
    found = {r["split"]: r.asDict() for r in split_summary(df, settings).collect()}
    for name in NAMES:
        if name not in found:
            raise SplitError(f"{name} is empty")
        if not found[name]["positives"]:
            raise SplitError(f"{name} has no positive")
        if found[name]["positives"] < few:
            log.warning("%s has only %d positives", name, found[name]["positives"])
    for earlier, later in zip(NAMES, NAMES[1:]):  # noqa: B905
        if found[earlier]["end_us"] > found[later]["start_us"]:
            raise SplitError(f"{earlier} overlaps {later} in time")
    return found


def build_splits(df: DataFrame, settings: Settings = DEFAULT, drop_burn_in: bool = True) -> DataFrame:
    """The ledger with its split; only train and validation lose the excluded rows."""
    parted = with_split(df, settings)
    kept = training_rows(parted.filter("split <> 'test'"), settings, drop_burn_in)
    return kept.unionByName(parted.filter("split = 'test'"))
