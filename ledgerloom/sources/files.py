"""Scans and sinks: raw CSV, Parquet stages, splits, reports."""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AccountsNotFoundError, AccountsSchemaError, LedgerNotFoundError, LedgerSchemaError, SplitError
from ..operators.clean import RAW_NAMES
from ..operators.enrich import RAW_ACCOUNT_NAMES
from ..operators.graph import as_float32
from . import store

log = logging.getLogger(__name__)

_RAW_TYPES = (T.StringType(), T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.DoubleType(), T.StringType(), T.DoubleType(), T.StringType(), T.StringType(), T.ByteType())
RAW_SCHEMA = T.StructType([T.StructField(n, t) for n, t in zip(RAW_NAMES, _RAW_TYPES, strict=True)])
ACCOUNT_SCHEMA = T.StructType([T.StructField(n, T.LongType() if n == "Bank ID" else T.StringType()) for n in RAW_ACCOUNT_NAMES])


def _csv(spark: SparkSession, path: str, schema: T.StructType, missing: type[Exception], malformed: type[Exception], rows: int | None) -> DataFrame:
    try:
        header = spark.read.text(path).limit(1).collect()
    except AnalysisException as e:
        raise missing(f"{path} can't be read: {e}") from e
    if not header:
        raise missing(f"{path} is empty")
    if len(header[0][0].split(",")) != len(schema):
        raise malformed(f"{path} has the header {header[0][0]!r}, not {len(schema)} columns")
    df = spark.read.schema(schema).options(header=True, enforceSchema=True, mode="FAILFAST").csv(path)
    return df if rows is None else df.limit(rows)


def with_place(df: DataFrame, name: str = "txn_id") -> DataFrame:
    """``df``, as scanned, with a number that follows the order of files (by path) and of the rows in
    each. A row fills a byte at least, so where its split begins, plus how many rows of the
    partition were before it, grows along a file: 40 bits for that, 23 for the file."""
    spark = df.sparkSession
    to_path = lambda f: spark._jvm.org.apache.hadoop.fs.Path(f).toString()
    paths = sorted(to_path(f) for f in df.inputFiles())
    at = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    if len(paths) < 2:
        return df.withColumn(name, at)
    known = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "__path string, __file long")
    known = F.broadcast(known) if len(paths) <= 100_000 else known  # a short row for each file
    placed = df.select("*", at.alias(name), F.col("_metadata.file_path").alias("__path")).join(known, "__path", "left")
    number = F.coalesce(F.col("__file"), F.raise_error(F.lit("a scanned file isn't in the listing")).cast("long"))
    return placed.withColumn(name, F.shiftleft(number, 40) + F.col(name)).drop("__path", "__file")


def read_transactions(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """The raw ledger, with ``txn_id``, its rows' place in the files; columns are bound by position,
    as its header repeats a name."""
    found = with_place(_csv(spark, path, RAW_SCHEMA, LedgerNotFoundError, LedgerSchemaError, None))
    return found if rows is None else found.limit(rows)


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, ACCOUNT_SCHEMA, AccountsNotFoundError, AccountsSchemaError, None)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_stage(df: DataFrame, path: str, small: bool = False, global_order: bool = False) -> str:
    """Parquet, rows of a file in order of time; ``small`` halves doubles; with ``global_order`` the
    files follow one another in time too."""
    out = as_float32(df) if small else df
    if "timestamp" in out.columns:
        out = out.orderBy("timestamp") if global_order else out.sortWithinPartitions("timestamp")
    out.write.mode("overwrite").parquet(path)
    log.info("wrote %s", path)
    return path


def write_splits(df: DataFrame, path: str) -> str:
    df.sortWithinPartitions("timestamp").write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def read_split(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One split; only its files are read. Reading the test set is said aloud."""
    if name not in ("train", "val", "test"):
        raise SplitError(f"no split is called {name!r}")
    if name == "test":
        log.warning("reading the test set: only the final evaluation should")
    return spark.read.parquet(path).where(F.col("split") == name)


def write_report(df: DataFrame, path: str) -> str:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def write_metrics(spark: SparkSession, metrics: Mapping, path: str) -> str:
    store.write_text(spark, path, json.dumps(metrics, indent=2, sort_keys=True, default=float))
    return path


def read_metrics(spark: SparkSession, path: str) -> dict:
    return json.loads(store.read_text(spark, path))


def write_pointer(spark: SparkSession, path: str) -> str:
    """Record md5 and size of a cold source beside it."""
    found, size = store.md5(spark, path)
    store.write_text(spark, f"{path}.pointer.json", json.dumps({"md5": found, "size": size}))
    return f"{path}.pointer.json"


def verify_pointer(spark: SparkSession, path: str) -> bool:
    """An error if a file isn't the one that its pointer records; False if it has no pointer."""
    if not store.exists(spark, f"{path}.pointer.json"):
        return False
    wanted = json.loads(store.read_text(spark, f"{path}.pointer.json"))
    if store.md5(spark, path) != (wanted["md5"], wanted["size"]):
        raise LedgerSchemaError(f"{path} is not the file its pointer records")
    return True
