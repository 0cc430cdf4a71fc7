"""The ledger as a view of the star-schema and event tables, for tests and benchmarks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators.clean import add_amount_delta, flag_burn_in, flag_self_loops

#: Settings for these tables: their formats, segments and dates.
VIEW_SETTINGS = replace(
    DEFAULT, simulation_end="2024-01-28", high_risk_formats=("error",), zero_positive_formats=("signup", "view"), entity_types=("AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY"),
    bank_pattern=r"^NATION_(\d+)$", rule_k_values=(100, 500, 1_000), k_values=(100, 500, 1_000, 5_000),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txn_id, timestamp, accounts, amount, format and label of each event."""
    event = table(spark, sf_dir, "events")
    odd = F.pmod(F.col("event_id") * 7919 + F.col("user_id") * 104729, F.lit(97))
    return event.select(
        F.col("event_id").alias("txn_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").cast("string").alias("src_account"),
        F.get_json_object("props", "$.k").alias("dst_account"), F.col("value").alias("amount_paid"), F.col("event_type").alias("payment_format"),
        (odd < F.when(F.col("event_type") == "error", 12).otherwise(2)).cast("int").alias("is_laundering"),
    )


def currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_key and the region it lies in."""
    customer, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.select(F.col("c_custkey").cast("string").alias("account_key"), F.col("r_name").alias("currency"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw account dimension, without the customers in debt, so that some accounts don't match."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customer.filter("c_acctbal > 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("string").alias("account_key"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("bank")
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clean ledger: ``transfers`` with currencies and the flags of cleaning."""
    out, rates = transfers(spark, sf_dir), currencies(spark, sf_dir)
    for side, name in (("src", "currency_paid"), ("dst", "currency_received")):
        out = out.join(rates.select(F.col("account_key").alias(f"{side}_account"), F.col("currency").alias(name)), f"{side}_account", "left")
    out = out.withColumn("amount_received", F.col("amount_paid") * (F.lit(1.0) - F.pmod(F.col("txn_id"), F.lit(3)) / F.lit(100.0)))
    return flag_burn_in(add_amount_delta(flag_self_loops(out)), VIEW_SETTINGS)
