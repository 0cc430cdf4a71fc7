"""From a raw ledger to a clean one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import namespaced, ratio, require_columns

#: Raw header positions and the names their columns get.
RAW_NAMES = (
    "timestamp", "src_bank", "src_account", "dst_bank", "dst_account", "amount_received",
    "currency_received", "amount_paid", "currency_paid", "payment_format", "is_laundering",
)
TIMESTAMP_FORMAT = "yyyy/MM/dd HH:mm"


def rename(df: DataFrame) -> DataFrame:
    """By position, as the raw header repeats a name."""
    return df.toDF(*RAW_NAMES, *df.columns[len(RAW_NAMES) :])


def parse_timestamp(df: DataFrame, fmt: str = TIMESTAMP_FORMAT) -> DataFrame:
    return df.withColumn("timestamp", F.to_timestamp("timestamp", fmt))


def drop_tail(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rows at or after the simulation's end go."""
    return df.filter(F.col("timestamp") < F.lit(settings.simulation_end).cast("timestamp"))


def tail_summary(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """What ``drop_tail`` takes from parsed rows: rows, dropped, dropped_positives, dropped_rate."""
    gone, y = F.col("timestamp") >= F.lit(settings.simulation_end).cast("timestamp"), F.col(settings.target).cast("long")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    found = df.agg(F.count(F.lit(1)).alias("rows"), count(gone.cast("long")).alias("dropped"), count(F.when(gone, y)).alias("dropped_positives"))
    return found.withColumn("dropped_rate", ratio(F.col("dropped_positives"), F.col("dropped")))


def namespace_accounts(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{s}_account": namespaced(f"{s}_bank", f"{s}_account") for s in ("src", "dst")})


def flag_self_loops(df: DataFrame) -> DataFrame:
    return df.withColumn("is_self_loop", F.col("src_account") == F.col("dst_account"))


def add_amount_delta(df: DataFrame) -> DataFrame:
    return df.withColumns({"is_cross_currency": F.col("currency_paid") != F.col("currency_received"), "amount_delta": F.col("amount_paid") - F.col("amount_received")})


def downcast(df: DataFrame) -> DataFrame:
    return df.withColumn("is_laundering", F.col("is_laundering").cast("tinyint"))


def flag_burn_in(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """True in the first days, counted from midnight before the first row."""
    start = df.agg(F.date_trunc("day", F.min("timestamp")).alias("__start"))
    limit = F.col("__start") + F.make_dt_interval(F.lit(settings.burn_in_days))
    return df.crossJoin(F.broadcast(start)).withColumn("is_burn_in", F.col("timestamp") < limit).drop("__start")


def add_txn_id(df: DataFrame) -> DataFrame:
    """A tie-breaker for equal timestamps, if the ledger has none (the CSV scan gives one: the place
    in the file): a hash of the row, counted on for rows that repeat. It is the same on every run
    and for every partitioning; rows that are equal in all columns may swap theirs."""
    if "txn_id" in df.columns:
        return df
    same = Window.partitionBy("__hash").orderBy(*[F.col(f"`{c}`") for c in df.columns])
    hashed = df.withColumn("__hash", F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), 1))
    return hashed.withColumn("txn_id", F.col("__hash") + F.row_number().over(same) - 1).drop("__hash")


def clean(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """All steps, as one lazy plan; rows without an account are refused at the ids."""
    require_columns(df, RAW_NAMES)
    steps = (parse_timestamp, lambda d: drop_tail(d, settings), namespace_accounts, flag_self_loops, add_amount_delta, downcast, add_txn_id, lambda d: flag_burn_in(d, settings))
    for step in steps:
        df = df.transform(step)
    return df


def summarise(df: DataFrame) -> DataFrame:
    """One row about a clean ledger; accounts are counted over both sides."""
    ends = df.select(F.explode(F.array("src_account", "dst_account")).alias("a")).agg(F.count_distinct("a").alias("unique_accounts"))
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    share = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c.removeprefix('is_')}_share")
    base = df.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col("is_laundering").cast("double")).alias("laundering_rate"), F.sum(F.col("is_laundering").cast("long")).alias("laundering_count"),
        share("is_self_loop"), share("is_cross_currency"), F.min(us).alias("start_us"), F.max(us).alias("end_us"),
        F.floor((F.max(us) - F.min(us)) / 86_400_000_000).cast("long").alias("days_covered"),
    )
    return base.crossJoin(ends)
