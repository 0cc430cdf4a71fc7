"""Ordered operators: running values over prior rows, ranks, quantiles, prefix sums.

Rows of an account are ordered by (timestamp, txn_id), as timestamps tie. Running values see
strictly earlier rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import micros
from ..scratch import materialize

ORDER = ("timestamp", "txn_id")


def ordered(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*ORDER)


def prior(*keys: str) -> WindowSpec:
    return ordered(*keys).rowsBetween(Window.unboundedPreceding, -1)


def prior_count(*keys: str) -> Column:
    return (F.row_number().over(ordered(*keys)) - 1).cast("long")


def prior_gap(*keys: str) -> Column:
    """Seconds since the key's row before."""
    return (micros("timestamp") - F.lag(micros("timestamp")).over(ordered(*keys))) / F.lit(1e6)


def first_of(*keys: str) -> Column:
    return F.row_number().over(ordered(*keys)) == 1


def running_distinct(first: str, *keys: str) -> Column:
    """Distinct counterparties before this row, from a flag that marks each one's first row:
    a distinct count over a window, which Spark doesn't have."""
    return F.coalesce(F.sum(F.col(first).cast("long")).over(prior(*keys)), F.lit(0)).cast("long")


def prior_mean(value: Column, *keys: str) -> Column:
    return F.avg(value).over(prior(*keys))


def prefix_sums(table: DataFrame, by: Sequence[str], order: str, sums: dict[str, str], bucket_rows: int = 1 << 20) -> DataFrame:
    """Running sums along ``order`` (distinct within ``by``): ``sums`` has the new column for each
    weight. ``table`` is one that ``materialize`` gave.

    Rows are dealt to value ranges of about ``bucket_rows``, as many as the table's size asks for;
    ranges are summed on their own, then each starts from the sum of those before it. No task sorts
    more than a range, so a group may hold most rows, or there may be no groups at all. The ranges
    are written out, as a sampled range partitioning isn't the same twice. Of one range, a plain
    window says the same."""
    names = list(by)
    ranges = max(1, -(-table.count() // bucket_rows))
    rows = (Window.unboundedPreceding, 0)
    if ranges == 1:
        upto = Window.partitionBy(*names or [F.lit(0)]).orderBy(order).rowsBetween(*rows)
        return table.withColumns({out: F.sum(w).over(upto) for w, out in sums.items()})
    placed = materialize(table.repartitionByRange(ranges, *names, order).withColumn("__bucket", F.spark_partition_id()))
    before = Window.partitionBy(*names or [F.lit(0)]).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*names, "__bucket").agg(*[F.sum(w).alias(f"__sum_{w}") for w in sums])
    starts = totals.select(*names, "__bucket", *[F.coalesce(F.sum(f"__sum_{w}").over(before), F.lit(0)).alias(f"__start_{w}") for w in sums])
    upto = Window.partitionBy(*names, "__bucket").orderBy(order).rowsBetween(*rows)
    summed = placed.join(starts, [*names, "__bucket"]).withColumns({out: F.col(f"__start_{w}") + F.sum(w).over(upto) for w, out in sums.items()})
    return summed.drop("__bucket", *[f"__start_{w}" for w in sums])


def with_pct_rank(df: DataFrame, value: str, by: str, out: str) -> DataFrame:
    """Average-rank percentile of ``value`` within ``by``: (smaller + (equal + 1) / 2) / all.

    Ranks are taken over distinct values, which is far smaller than the rows where a group is
    large, and joined back; NULL groups or values have no rank, and are spread over all tasks of
    that join."""
    counts = df.filter(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("__equal"))
    counts = materialize(counts)
    ranked = prefix_sums(counts, [by], value, {"__equal": "__upto"})
    totals = counts.groupBy(by).agg(F.sum("__equal").alias("__all"))
    pct = ranked.join(totals, by).select(by, value, ((F.col("__upto") - F.col("__equal") + (F.col("__equal") + 1) / 2) / F.col("__all")).alias(out), F.lit(0).cast("long").alias("__apart"))
    unranked = F.col(value).isNull() | F.col(by).isNull()
    apart = F.when(unranked, F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])).otherwise(F.lit(0).cast("long"))
    return df.withColumn("__apart", apart).join(pct, [by, value, "__apart"], "left").drop("__apart")


def counted_quantiles(counts: DataFrame, value: str, count: str, shares: Sequence[float]) -> list[float | None]:
    """Quantiles with linear interpolation, as one value each, of a table that says how often each
    value occurs: positions are looked up in the running counts, so nothing is sorted in one place."""
    n = counts.agg(F.sum(count)).first()[0]
    if not n:
        return [None] * len(shares)
    places = sorted({int(f(q * (n - 1))) for q in shares for f in (lambda x: x // 1, lambda x: -(-x // 1))})
    upto = prefix_sums(counts.select(value, count), [], value, {count: "__upto"})
    found = upto.agg(*[F.min(F.when(F.col("__upto") > p, F.col(value))).alias(f"p{p}") for p in places]).first()
    out = []
    for q in shares:
        at = q * (n - 1)
        low, high = found[f"p{int(at // 1)}"], found[f"p{int(-(-at // 1))}"]
        out.append(low + (high - low) * (at - at // 1) if high != low else low)
    return out


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> list[float | None]:
    """``counted_quantiles`` of a column; NULLs don't count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    return counted_quantiles(materialize(counts), value, "__n", shares)


def quantiles_by(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and the quantiles of ``value`` in each group, read off running counts of its distinct
    values: no task holds those of a whole group."""
    counts = materialize(df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("__n")))
    totals = counts.groupBy(by).agg(F.sum("__n").alias("__all"))
    upto = prefix_sums(counts, [by], value, {"__n": "__upto"}).join(totals, by)
    cells = []
    for name, q in shares.items():
        at = F.lit(q) * (F.col("__all") - 1)
        cells += [F.min(F.when(F.col("__upto") > f(at), F.col(value))).alias(f"{name}{end}") for f, end in ((F.floor, "_low"), (F.ceil, "_high"))]
    found = upto.groupBy(by).agg(F.max("__all").alias("__all"), *cells)
    place = lambda q: F.lit(q) * (F.col("__all") - 1)
    return found.select(by, *[(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * (place(q) - F.floor(place(q)))).alias(n) for n, q in shares.items()])


def bucket_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of the interval (edge, next edge] a value lies in; the first includes its edge."""
    inner = list(edges)[1:-1]
    out = F.when(value.isNull(), None)
    for i, edge in enumerate(inner):
        out = out.when(value <= edge, i)
    return out.otherwise(len(inner)).cast("int")


def quantile_bucket(counts: DataFrame, value: str, count: str, bins: int) -> Column:
    """Buckets of equal size by exact quantiles of counted values; equal edges are merged."""
    edges = list(dict.fromkeys(counted_quantiles(counts, value, count, [i / bins for i in range(bins + 1)])))
    return bucket_of(F.col(value), edges)
