"""Tables that cut a lineage: written to the folder all machines share, then read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where they go if no shared folder is named and driver and executors are one machine.
LOCAL_SHARED = "/tmp/checkpoints/ledgerloom"


_leaving: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a local one if the master is
    local; on a cluster this is an error, as executors couldn't read each other's parts."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/ledgerloom"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return LOCAL_SHARED


def new_path(spark: SparkSession) -> str:
    """A path of this application's own in the shared folder, for whatever goes there and back."""
    return f"{_own(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: this cuts the
    lineage, survives lost executors and computes costly columns once."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    own = _own(spark)
    if own not in _leaving:  # what is left goes with the application
        _leaving.add(own)
        at = spark._jvm.org.apache.hadoop.fs.Path(own)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove the table behind a frame that ``materialize`` gave, once nothing reads it any more."""
    _delete(df.sparkSession, df._scratch_path)


def clear(spark: SparkSession) -> None:
    """Remove what this application has written; results that still read it must be done."""
    _delete(spark, _own(spark))


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
