"""The account dimension, and its guarded many-to-one join to both sides of a transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..errors import AccountsSchemaError, DuplicateAccountKeyError, RowCountError
from ..functions.columns import extracted, namespaced, require_columns, whitelisted

#: Columns of the raw dimension.
RAW_ACCOUNT_NAMES = ("Bank Name", "Bank ID", "Account Number", "Entity ID", "Entity Name")
ATTRIBUTES = ("entity_type", "bank_country")


def clean_accounts(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """account_key, entity_type and bank_country; names and entity ids go no further."""
    require_columns(df, RAW_ACCOUNT_NAMES, AccountsSchemaError)
    kind = F.trim(F.substring_index(F.col("Entity Name"), "#", 1))
    out = df.select(
        namespaced("Bank ID", "Account Number").alias("account_key"),
        whitelisted(kind, settings.entity_types).alias("entity_type"),
        extracted(F.col("Bank Name"), settings.bank_pattern, settings.bank_default).alias("bank_country"),
    )
    return out


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys or ("account_key",)).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` itself, if no key stands twice; otherwise an error that names some."""
    keys = keys or ("account_key",)
    some = [tuple(r[k] for k in keys) for r in duplicate_keys(df, *keys).orderBy(*keys).limit(5).collect()]
    if some:
        raise DuplicateAccountKeyError(f"keys {keys} stand twice, such as {some}")
    return df


def require_same_rows(before: DataFrame, after: DataFrame, step: str = "the step") -> DataFrame:
    """``after``, if it has as many rows as ``before``."""
    had, has = before.count(), after.count()
    if had != has:
        raise RowCountError(f"{step} made {has} rows of {had}")
    return after


def merge_accounts(transactions: DataFrame, accounts: DataFrame, validate: bool = True) -> DataFrame:
    """Attributes of both accounts, prefixed by side; unmatched ones are NULL. With unique keys on
    the right a left join keeps every transaction once; the plan decides how, by measured size."""
    accounts = require_unique(accounts) if validate else accounts
    for side in ("src", "dst"):
        own = accounts.select(F.col("account_key").alias(f"{side}_account"), *[F.col(a).alias(f"{side}_{a}") for a in ATTRIBUTES])
        transactions = transactions.join(own, f"{side}_account", "left")
    return transactions


def summarise_merge(df: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), share(F.col("src_entity_type").isNull()).alias("unmatched_src"), share(F.col("dst_entity_type").isNull()).alias("unmatched_dst"),
        F.count_distinct("src_entity_type").alias("src_entity_types"), F.count_distinct("src_bank_country").alias("src_bank_countries"),
        share(F.col("src_bank_country") == F.col("dst_bank_country")).alias("same_country_share"), share(F.col("src_entity_type") == F.col("dst_entity_type")).alias("same_entity_share"),
    )
