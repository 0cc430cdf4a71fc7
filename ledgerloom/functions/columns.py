"""Scalar expressions that several operators share. Missing is NULL throughout, never NaN."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import LedgerSchemaError


def require_columns(df, columns, error: type[Exception] = LedgerSchemaError, source: str = "the table"):
    """``df`` itself, if it has all ``columns``; extra ones are fine."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise error(f"{source} lacks columns: {missing}")
    return df


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def ratio(top: Column, bottom: Column) -> Column:
    """NULL for a zero denominator."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def flag(condition: Column) -> Column:
    """False where the condition can't be told."""
    return F.coalesce(condition, F.lit(False))


def known(value: Column) -> Column:
    """NaN counts as missing, as Spark would order it above every number."""
    return F.when(~F.isnan(value), value)


def namespaced(bank: str, account: str) -> Column:
    """``bank_account``; numeric bank ids lose leading zeros on both sides of a join alike."""
    return F.concat(F.col(bank).cast("string"), F.lit("_"), F.col(account).cast("string"))


def whitelisted(value: Column, allowed, other: str = "Other") -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(other))


def extracted(value: Column, pattern: str, default: str) -> Column:
    """First group of the pattern; ``default`` for NULL or no match."""
    return F.trim(F.coalesce(F.nullif(F.regexp_extract(value, pattern, 1), F.lit("")), F.lit(default)))


def hour_angle(hour: Column) -> Column:
    return F.lit(2 * pi) * hour / F.lit(24.0)


def clipped(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def tie_break(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order of rows, the same on every run and for every partitioning.
    The key is reduced before the product, so no key is too large for it."""
    prime = F.lit(1_000_003)
    return F.pmod(F.pmod(key, prime) * F.lit(2_654_435_761 + seed - 42), prime)


def number_after(value: Column, mark: str = "#") -> Column:
    """The digits that follow the first ``mark`` as a double; NULL where none do."""
    return F.nullif(F.regexp_extract(value, f"{mark}(\\d+)", 1), F.lit("")).cast("double")
