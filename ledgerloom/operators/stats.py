"""Tests and correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import erfc, exp, lgamma, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .windows import prefix_sums


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n for every pair of values that occurs."""
    return df.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def two_by_two(df: DataFrame, a: str, b: str) -> tuple[int, int, int, int]:
    """Rows with (not a, not b), (not a, b), (a, not b), (a, b)."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    cells = [F.coalesce(F.sum((p & q).cast("long")), F.lit(0)) for p in (~x, x) for q in (~y, y)]
    return tuple(df.agg(*cells).first())


def chi2_yates(table: Sequence[int]) -> tuple[float, float]:
    """Statistic with Yates' correction, and its p-value at one degree of freedom."""
    a, b, c, d = table
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    if not margins:
        return 0.0, 1.0
    stat = n * max(0.0, abs(a * d - b * c) - n / 2) ** 2 / margins
    return stat, erfc(sqrt(stat / 2))


def fisher_exact(table: Sequence[int]) -> tuple[float, float]:
    """Odds ratio, and the two-sided p-value: the chance of all tables no likelier than this.

    Chances fall on both sides of the mode, so on each side the sum begins where they come down to
    the table's own, found by halving, and ends where nothing is added any more."""
    a, b, c, d = table
    row, column, n = a + b, a + c, a + b + c + d
    choose = lambda m, k: lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1)
    chance = lambda k: exp(choose(row, k) + choose(n - row, column - k) - choose(n, column))
    least, most = max(0, column - (n - row)), min(row, column)
    mode = min(most, max(least, (row + 1) * (column + 1) // (n + 2)))
    own = chance(a) * (1 + 1e-7)
    p = 0.0
    for step, edge in ((-1, least), (1, most)):
        near, far = mode + (step > 0), edge + step  # the side's first place, and the one beyond its last
        low, high = 0, max(0, (far - near) * step)
        while low < high:  # how many places from the mode are likelier than the table
            middle = (low + high) // 2
            low, high = (middle + 1, high) if chance(near + step * middle) > own else (low, middle)
        k = near + step * low
        while (far - k) * step > 0 and (x := chance(k)) > p * 1e-17:
            p += x
            k += step
    return (a * d / (b * c) if b * c else float("inf") if a * d else float("nan")), min(1.0, p)


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r for each pair of columns, over rows that have both; one pass."""
    pairs = list(combinations(columns, 2))
    both = lambda a, b: [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c).cast("double")) for c in (a, b)]
    one = df.agg(*[F.corr(*both(a, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r: Pearson's r of average ranks, taken for each pair over rows that have both.

    The columns are computed once. A column is ranked once for each set of rows that a pair leaves
    it, over its distinct values."""
    own = materialize(df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]))
    full = [i for i, n in enumerate(own.agg(*[F.count_if(F.col(f"v{i}").isNull()) for i in range(len(columns))]).first()) if not n]
    ranked: dict[tuple[int, frozenset[int]], DataFrame] = {}

    def ranks(i: int, rows: frozenset[int]) -> DataFrame:
        if (i, rows) not in ranked:
            some = own.filter(" and ".join([f"v{k} is not null" for k in sorted(rows)]) or "true")
            counts = materialize(some.groupBy(f"v{i}").agg(F.count(F.lit(1)).alias("__equal")))
            ranked[i, rows] = materialize(prefix_sums(counts, [], f"v{i}", {"__equal": "__upto"}).select(f"v{i}", (F.col("__upto") - (F.col("__equal") - 1) / 2).alias(f"r{i}")))
        return ranked[i, rows]

    out = None
    for i, j in combinations(range(len(columns)), 2):
        rows = frozenset({i, j}.difference(full))
        pair = own.select(f"v{i}", f"v{j}").filter(F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull())
        pair = pair.join(ranks(i, rows), f"v{i}").join(ranks(j, rows), f"v{j}")
        one = pair.agg(F.corr(f"r{i}", f"r{j}").alias("r")).select(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), "r")
        out = one if out is None else out.union(one)
    return out


def strong_pairs(correlations: DataFrame, least: float = 0.7) -> DataFrame:
    return correlations.filter(F.abs("r") > least).orderBy(F.desc(F.abs("r")))


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, vif: how far the others explain each column, over rows that have all; the diagonal of
    the inverted correlation matrix, whose size is that of ``columns``. NULL where they explain all."""
    own = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).dropna()
    pairs = list(combinations(range(len(columns)), 2))
    found = own.agg(*[F.corr(f"v{i}", f"v{j}").alias(f"r{i}_{j}") for i, j in pairs]).first() if pairs else ()
    matrix = np.eye(len(columns))
    for (i, j), r in zip(pairs, found, strict=True):
        matrix[i, j] = matrix[j, i] = np.nan if r is None else r
    ok = np.isfinite(matrix).all() and np.linalg.matrix_rank(matrix) == len(columns)
    values = np.diag(np.linalg.inv(matrix)).tolist() if ok else [None] * len(columns)
    return df.sparkSession.createDataFrame(list(zip(columns, values, strict=True)), "column string, vif double")
