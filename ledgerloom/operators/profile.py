"""Exploration: what columns hold, and how the target's rate varies with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import flag, ratio
from ..scratch import materialize
from .windows import quantile_bucket, quantiles_by


def _totals(df: DataFrame, settings: Settings) -> DataFrame:
    y = F.col(settings.target)
    return df.agg(F.count(F.lit(1)).alias("__n"), F.avg(y.cast("double")).alias("__rate"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, dtype, nulls, null_pct, unique, unique_pct, example, is_constant, is_identifier.

    Each value meets its column's name once; distinct counts are spread over (column, value)."""
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    pair = lambda c: F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col(f"`{c}`").cast("string").alias("v"))
    long = df.select(F.explode(F.array(*[pair(c) for c in columns])).alias("x")).select("x.*")
    found = long.groupBy("column", "dtype").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").isNull().cast("long")).alias("nulls"), F.count_distinct("v").alias("unique"), F.min("v").alias("example"))
    share = ratio(F.col("unique"), F.col("n"))
    return found.select("column", "dtype", "nulls", ratio(F.col("nulls"), F.col("n")).alias("null_pct"), "unique", share.alias("unique_pct"), "example", (F.col("unique") <= 1).alias("is_constant"), (share > 0.9).alias("is_identifier"))


def target_balance(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    y = F.col(settings.target).cast("long")
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(y).alias("positives"), F.avg(y.cast("double")).alias("rate"))
    return found.withColumn("imbalance", ratio(F.col("rows") - F.col("positives"), F.col("positives")))


def categorical_lift(df: DataFrame, column: str, settings: Settings = DEFAULT, min_group: int = 0) -> DataFrame:
    """value, n, positives, rate, share, lift of each category with ``min_group`` rows or more."""
    y = F.col(settings.target)
    found = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.sum(y.cast("long")).alias("positives"), F.avg(y.cast("double")).alias("rate"))
    both = found.filter(F.col("n") >= min_group).crossJoin(F.broadcast(_totals(df, settings)))
    return both.select("value", "n", "positives", "rate", ratio(F.col("n"), F.col("__n")).alias("share"), ratio(F.col("rate"), F.col("__rate")).alias("lift"))


def zero_positive(lift: DataFrame) -> DataFrame:
    return lift.filter("positives = 0")


def boolean_lift(df: DataFrame, column: str, settings: Settings = DEFAULT) -> DataFrame:
    return categorical_lift(df, column, settings).drop("share")


def numeric_describe(df: DataFrame, column: str, settings: Settings = DEFAULT, by: str | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, p95, p99 and max by class."""
    own = df.select(F.col(by or settings.target).cast("long").alias("class"), F.col(column).cast("double").alias("x"))
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    found = own.groupBy("class").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    quantiles = quantiles_by(own, "class", "x", shares).withColumnRenamed("class", "__class")
    both = found.join(quantiles, F.col("class").eqNullSafe(F.col("__class")), "left")
    return both.select("class", "count", "mean", "std", "min", *shares, "max")


def transposed(described: DataFrame, key: str = "class") -> DataFrame:
    """A row for each statistic, a column for each class."""
    return described.unpivot([key], [c for c in described.columns if c != key], "statistic", "value").groupBy("statistic").pivot(key).agg(F.first("value"))


def decile_rates(df: DataFrame, column: str, settings: Settings = DEFAULT, bins: int = 10) -> DataFrame:
    """bin, n and the target's rate in bins of equal size; ``df`` is read once, for its distinct values."""
    known = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v"))
    counts = materialize(known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(settings.target).cast("double")).alias("p")))
    by = counts.withColumn("bin", quantile_bucket(counts, "v", "n", bins)).groupBy("bin")
    return by.agg(F.sum("n").alias("n"), (F.sum("p") / F.sum("n")).alias("rate"))


def temporal_rollup(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """unit (hour, dayofweek with Monday 0), value, n, positives, rate; one scan for both."""
    ts, y = F.col("timestamp").cast("timestamp"), F.col(settings.target)
    units = F.array(F.struct(F.lit("hour").alias("unit"), F.hour(ts).cast("long").alias("value")), F.struct(F.lit("dayofweek").alias("unit"), F.weekday(ts).cast("long").alias("value")))
    return df.select(F.explode(units).alias("u"), y.alias("y")).groupBy("u.unit", "u.value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("positives"), F.avg(F.col("y").cast("double")).alias("rate"))


def daily_rollup(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    y = F.col(settings.target)
    return df.groupBy(F.to_date("timestamp").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(y.cast("long")).alias("positives"), F.avg(y.cast("double")).alias("rate"))


def group_stats(df: DataFrame, by: str, value: str, distinct: str) -> DataFrame:
    """n, median, p95 of a value and distinct others, for each group."""
    own = df.select(F.col(by).alias("group"), F.col(value).cast("double").alias("x"), F.col(distinct).alias("d"))
    found = own.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("d").alias("distinct"))
    quantiles = quantiles_by(own, "group", "x", {"median": 0.5, "p95": 0.95}).withColumnRenamed("group", "__group")
    return found.join(quantiles, F.col("group").eqNullSafe(F.col("__group")), "left").select("group", "n", "median", "p95", "distinct")


def threshold_sweep(df: DataFrame, column: str, thresholds: Sequence[float], above: bool = True, settings: Settings = DEFAULT) -> DataFrame:
    """threshold, n, positives, lift of the rows above (or below) each; one pass for all."""
    y = F.col(settings.target)
    cells = []
    for i, t in enumerate(thresholds):
        hit = flag(F.col(column) > t if above else F.col(column) < t)
        cells += [F.sum(hit.cast("long")).alias(f"n{i}"), F.sum((hit & (y == 1)).cast("long")).alias(f"p{i}")]
    one = df.agg(F.avg(y.cast("double")).alias("rate"), *cells)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"p{i}").alias("positives")) for i, t in enumerate(thresholds)])
    return one.select("rate", F.explode(rows).alias("r")).select("r.*", ratio(ratio(F.col("r.positives"), F.col("r.n")), F.col("rate")).alias("lift"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def missingness(df: DataFrame, column: str, settings: Settings = DEFAULT) -> DataFrame:
    y = F.col(settings.target)
    return df.groupBy(F.col(column).isNull().alias("is_missing")).agg(F.count(F.lit(1)).alias("n"), F.avg(y.cast("double")).alias("rate"))


def conditional_rates(df: DataFrame, conditions: dict[str, Column], by: str, settings: Settings = DEFAULT) -> DataFrame:
    """Share of rows and mean target where each condition holds, for each group."""
    y = F.col(settings.target).cast("double")
    return df.groupBy(by).agg(*[c for name, cond in conditions.items() for c in (F.avg(flag(cond).cast("double")).alias(f"{name}_share"), F.avg(F.when(cond, y)).alias(f"{name}_rate"))])


def composition(df: DataFrame, column: str, value: str, settings: Settings = DEFAULT, by: str = "split") -> DataFrame:
    """Share that one category has of the rows and of the positives, for each split."""
    here, y = F.col(column) == value, F.col(settings.target).cast("long")
    found = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum(y).alias("positives"), F.sum(here.cast("long")).alias("r"), F.sum(F.when(here, y).otherwise(0)).alias("p"))
    return found.select(by, "rows", "positives", ratio(F.col("r"), F.col("rows")).alias("row_share"), ratio(F.col("p"), F.col("positives")).alias("positive_share"))


def log_histogram(df: DataFrame, column: str, settings: Settings = DEFAULT, bins: int = 50, top: float = 12.0) -> DataFrame:
    """Counts by class in bins of log10(1 + x): the data behind a plot."""
    x = F.log10(F.lit(1.0) + F.col(column))
    bin_ = F.least(F.lit(bins - 1), F.floor(x / F.lit(top / bins))).cast("int")
    return df.filter(F.col(column) >= 0).groupBy(F.col(settings.target).cast("long").alias("class"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sample_for_plots(df: DataFrame, n: int = 200_000, settings: Settings = DEFAULT, key: str = "txn_id") -> DataFrame:
    """All positives, and exactly ``n`` of the others (all, if fewer): those of the smallest hash of
    the key, so the sample is the same on every run."""
    positives = df.filter(F.col(settings.target) == 1)
    others = df.filter(F.coalesce(F.col(settings.target) != 1, F.lit(True)))
    drawn = others.select(F.xxhash64(F.col(key), F.lit(settings.random_state)).alias("__h"), F.col(key).alias("__key")).orderBy("__h", "__key").limit(n)
    return positives.unionByName(others.join(drawn.select("__key"), others[key] == F.col("__key"), "left_semi"))


def log_zscore(df: DataFrame, value: str = "amount_paid", by: str = "currency_paid", out: str = "amt_logz_ccy") -> DataFrame:
    """(log1p - mean) / sample std within a group; group figures are joined, not windowed."""
    x = F.log1p(value)
    stats = df.groupBy(by).agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    return df.join(stats, by, "left").withColumn(out, (x - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))).drop("__m", "__s")


def rejected_history(df: DataFrame) -> DataFrame:
    """Variants that were measured and left out: arithmetic prior mean, log ratio to it, newness."""
    order = Window.partitionBy("src_account").orderBy("timestamp", "txn_id").rowsBetween(Window.unboundedPreceding, -1)
    mean = F.avg("amount_paid").over(order)
    return df.withColumns({"src_amt_mean_prior": mean, "src_amt_sum_prior": F.sum("amount_paid").over(order), "src_amt_vs_own": F.col("amount_paid") / F.nullif(mean, F.lit(0.0)), "src_is_new": mean.isNull()}).withColumn("src_log_ratio", F.when(F.col("src_amt_vs_own") > 0, F.log("src_amt_vs_own")))


def first_rows(df: DataFrame, key: str = "src_account") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy("timestamp", "txn_id"))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
