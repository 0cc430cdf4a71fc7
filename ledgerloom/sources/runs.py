"""An experiment store: runs as a Parquet table, models beside it."""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store as fs


def log_run(spark: SparkSession, store: str, name: str, stage: str, params: dict, metrics: dict, model: PipelineModel | None = None, signature: dict | None = None) -> str:
    """Append a run; a model and the schema it expects are saved beside it."""
    run_id = uuid.uuid4().hex
    if model is not None:
        model.write().overwrite().save(f"{store}/models/{run_id}")
    row = [(run_id, name, stage, json.dumps(params, sort_keys=True, default=str), json.dumps(signature or {}), {k: float(v) for k, v in metrics.items() if v is not None})]
    spark.createDataFrame(row, "run_id string, name string, stage string, params string, signature string, metrics map<string,double>").write.mode("append").parquet(f"{store}/runs")
    return run_id


def search_runs(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/runs")


def eligible_runs(table: DataFrame, metric: str = "pr_auc", exclude: str = "smote") -> DataFrame:
    """Runs that have the metric and whose name doesn't contain ``exclude``."""
    return table.filter(~F.coalesce(F.col("name").contains(exclude), F.lit(False)) & F.col("metrics")[metric].isNotNull())


def top_run(table: DataFrame, metric: str = "pr_auc", exclude: str = "smote") -> DataFrame:
    """The eligible run of the highest metric, of equal ones the first by id, as one row or none."""
    return eligible_runs(table, metric, exclude).orderBy(F.desc(F.col("metrics")[metric]), "run_id").limit(1)


def best_run(spark: SparkSession, store: str, metric: str = "pr_auc", exclude: str = "smote"):
    """``top_run`` of a store, as its row; None if there is none."""
    return top_run(search_runs(spark, store), metric, exclude).first()


def register_model(spark: SparkSession, store: str, name: str, run_id: str, signature: dict, example: DataFrame) -> int:
    """A new version of a registered model: a run's model with the columns it takes and gives, and
    some rows as an example. Returns the version, from 1."""
    known = spark.read.parquet(f"{store}/registry").filter(F.col("name") == name) if fs.exists(spark, f"{store}/registry") else None
    version = 1 + (known.agg(F.max("version")).first()[0] or 0 if known is not None else 0)
    rows = [json.dumps(r.asDict(), sort_keys=True, default=str) for r in example.limit(5).collect()]
    row = [(name, version, run_id, json.dumps(signature, sort_keys=True), rows)]
    spark.createDataFrame(row, "name string, version long, run_id string, signature string, example array<string>").write.mode("append").parquet(f"{store}/registry")
    return version


def registered_model(spark: SparkSession, store: str, name: str):
    """The latest version of a registered model, as its row; None without one."""
    if not fs.exists(spark, f"{store}/registry"):
        return None
    return spark.read.parquet(f"{store}/registry").filter(F.col("name") == name).orderBy(F.desc("version")).first()


def load_model(store: str, run_id: str) -> PipelineModel:
    return PipelineModel.load(f"{store}/models/{run_id}")
