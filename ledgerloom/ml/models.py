"""Preprocessing and models over the feature table."""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BOOLEAN_FEATURES, CATEGORICAL_FEATURES, DEFAULT, NUMERIC_FEATURES, Settings
from ..errors import ModelUnavailableError
from ..functions.columns import known
from ..operators.graph import model_inputs
from ..operators.windows import quantiles_by
from ..scratch import materialize

log = logging.getLogger(__name__)
RARE = "__infrequent__"
#: What stands for a missing number where the model can part it off.
MISSING = -1e9
#: Kinds of models that need a library besides Spark, and which.
EXTERNAL = {"xgboost": "xgboost"}


def _long(df: DataFrame, columns: Sequence[str], kind: str, missing: str | None = None) -> DataFrame:
    """(column, value) of all cells of some columns."""
    value = lambda c: F.col(c).cast(kind) if missing is None else F.coalesce(F.col(c).cast(kind), F.lit(missing))
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns])).alias("x")).select("x.*")


def medians_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, median (exact; columns without a value are missing)."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, median double")
    return quantiles_by(_long(df, columns, "double").filter(~F.isnan("value")), "column", "value", {"median": 0.5})


def frequent_categories(df: DataFrame, columns: Sequence[str], min_share: float = 0.01) -> DataFrame:
    """column, value of the categories that ``min_share`` of the rows have; missing is "Unknown"."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string")
    counts = _long(df, columns, "string", "Unknown").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("all"))
    return counts.join(totals, "column").filter(F.col("n") >= min_share * F.col("all")).select("column", "value")


@dataclass
class Prepared:
    """What preprocessing learned: medians, and the categories frequent enough to stand alone."""

    numeric: tuple[str, ...]
    boolean: tuple[str, ...]
    medians: dict[str, float]
    frequent: dict[str, list[str]]
    native: bool = False

    @classmethod
    def fit(cls, df: DataFrame, numeric: Sequence[str] | None = None, boolean: Sequence[str] | None = None, categorical: Sequence[str] = CATEGORICAL_FEATURES, min_share: float = 0.01) -> Prepared:
        """By default all history features and all graph features that the table has. Medians and
        categories take one pass each, whatever the number of columns."""
        types = dict(df.dtypes)
        graph = model_inputs(df.columns)
        flags = [c for c in graph if types[c] == "boolean"]
        numeric = tuple(c for c in (numeric if numeric is not None else (*NUMERIC_FEATURES, *[c for c in graph if c not in flags])) if c in types)
        boolean = tuple(c for c in (boolean if boolean is not None else (*BOOLEAN_FEATURES, *flags)) if c in types)
        categorical = [c for c in categorical if c in types]
        medians = {r["column"]: r["median"] for r in medians_of(df, numeric).collect()}
        frequent: dict[str, list[str]] = {c: [] for c in categorical}
        for r in frequent_categories(df, categorical, min_share).collect():
            frequent[r["column"]].append(r["value"])
        return cls(numeric, boolean, {c: medians.get(c) or 0.0 for c in numeric}, {c: sorted(v) for c, v in frequent.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        """Medians for missing numbers (``native``: a number below all, which trees can part off)
        with a flag beside each, "Unknown" for missing categories, one value for all rare ones."""
        out = {}
        for c in self.numeric:
            out[f"n_{c}"] = F.coalesce(known(F.col(c).cast("double")), F.lit(MISSING if self.native else self.medians[c]))
            out[f"m_{c}"] = known(F.col(c).cast("double")).isNull().cast("double")
        for c in self.boolean:
            out[f"b_{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        for c, values in self.frequent.items():
            v = F.coalesce(F.col(c), F.lit("Unknown"))
            out[f"c_{c}"] = F.when(v.isin(*values), v).otherwise(F.lit(RARE)) if values else F.lit(RARE)
        return df.withColumns(out)

    def stages(self, scale: bool) -> list:
        """Scaled numbers, flags and one-hot categories in one vector; unseen categories are all 0."""
        categories = [f"c_{c}" for c in self.frequent]
        numbers = VectorAssembler(inputCols=[f"n_{c}" for c in self.numeric], outputCol="numbers")
        first = [numbers, StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)] if scale else [numbers]
        encode = [
            StringIndexer(inputCols=categories, outputCols=[f"{c}_i" for c in categories], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_v" for c in categories], handleInvalid="keep"),
        ] if categories else []
        rest = [f"m_{c}" for c in self.numeric] + [f"b_{c}" for c in self.boolean] + [f"{c}_v" for c in categories]
        return [*first, *encode, VectorAssembler(inputCols=["scaled" if scale else "numbers", *rest], outputCol="features")]


@dataclass
class ModelSpec:
    name: str
    kind: str
    params: dict = field(default_factory=dict)
    weighted: bool = True
    oversample: bool = False


def default_specs() -> list[ModelSpec]:
    """The models that are compared. Boosted trees stand in where no other library is installed."""
    return [
        ModelSpec("logreg", "logreg", {"C": 1.0}), ModelSpec("random_forest", "forest", {"trees": 300, "depth": 12, "min_leaf": 50}),
        ModelSpec("boosted_weighted", "boosted", {"rounds": 400, "depth": 6, "step": 0.05, "subsample": 0.8, "colsample": 0.8}),
        ModelSpec("boosted_smote", "boosted", {"rounds": 400, "depth": 6, "step": 0.05, "subsample": 0.8, "colsample": 0.8}, weighted=False, oversample=True),
    ]


def estimator(spec: ModelSpec, n: int, settings: Settings = DEFAULT):
    p, weight = spec.params, {"weightCol": "weight"}
    base = {"labelCol": settings.target, "featuresCol": "features"}
    if spec.kind == "logreg":
        return LogisticRegression(maxIter=int(p.get("max_iter", 1000)), regParam=1.0 / (p.get("C", 1.0) * max(1, n)), standardization=False, **base, **weight)
    if spec.kind == "forest":
        return RandomForestClassifier(numTrees=int(p.get("trees", 300)), maxDepth=int(p.get("depth", 12)), minInstancesPerNode=int(p.get("min_leaf", 50)), seed=settings.random_state, **base, **weight)
    if spec.kind == "boosted":
        return GBTClassifier(maxIter=int(p.get("rounds", 400)), maxDepth=int(p.get("depth", 6)), stepSize=p.get("step", 0.05), subsamplingRate=p.get("subsample", 0.8), featureSubsetStrategy=str(p.get("colsample", 0.8)), minInstancesPerNode=int(p.get("min_leaf", 1)), seed=settings.random_state, **base, **weight)
    if spec.kind in EXTERNAL:
        raise ModelUnavailableError(f"{spec.kind} needs {EXTERNAL[spec.kind]}, which isn't installed")
    raise ValueError(f"no model is of the kind {spec.kind!r}")


def with_weight(df: DataFrame, settings: Settings = DEFAULT, balanced: bool = True) -> DataFrame:
    """Class weights n / (2 * class size), or 1."""
    if not balanced:
        return df.withColumn("weight", F.lit(1.0))
    y = F.col(settings.target)
    sizes = df.agg(F.sum((y == 1).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    p, n = max(1, sizes["p"] or 0), max(1, sizes["n"])
    return df.withColumn("weight", F.when(y == 1, n / (2 * p)).otherwise(n / (2 * max(1, n - p))))


def nearest_others(points: DataFrame, k: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """(i, place, z): the ``k`` nearest other points (i long, x array<double>) of each, nearest first,
    ties to the smaller i. Points meet block after block of them, and a task hands on no more than
    k for each, so neither a task nor the driver holds all."""
    spark = points.sparkSession
    schema = "i long, j long, d double, z array<double>"

    def met(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([r["i"] for r in block]), np.array([r["x"] for r in block], float)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = sent.value
            best_d, best_j, best_z = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0, asked.shape[1]))
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, x = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), float)
                d = ((asked**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * asked @ x.T).clip(0.0)
                d[ids[:, None] == own[None]] = np.inf
                near = np.lexsort((np.broadcast_to(own, d.shape), d), axis=1)[:, :k]
                d, j, z = np.take_along_axis(d, near, 1), own[near], x[near]
                d, j, z = np.hstack([best_d, d]), np.hstack([best_j, j]), np.concatenate([best_z, z], axis=1)
                near = np.lexsort((j, d), axis=1)[:, :k]
                best_d, best_j, best_z = np.take_along_axis(d, near, 1), np.take_along_axis(j, near, 1), np.take_along_axis(z, near[:, :, None], 1)
            q, c = np.nonzero(np.isfinite(best_d))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_j[q, c]), pa.array(best_d[q, c]), pa.array(list(best_z[q, c]), pa.list_(pa.float64()))], names=["i", "j", "d", "z"])

        return points.select("i", "x").mapInArrow(run, schema)

    out, block, held = None, [], 0
    for row in points.select("i", "x").toLocalIterator():
        block.append(row)
        held += 8 * len(row["x"])
        if held >= block_bytes:
            one = materialize(met(block))
            out, block, held = one if out is None else out.union(one), [], 0
    if block or out is None:
        last = met(block) if block else spark.createDataFrame([], schema)
        out = last if out is None else out.union(last)
    place = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return out.withColumn("place", place).filter(F.col("place") <= k).select("i", "place", "z")


def oversampled(df: DataFrame, settings: Settings = DEFAULT, neighbours: int = 5, share: float = 0.1) -> DataFrame:
    """Positives joined by points between a positive and one of its nearest: SMOTE on the vectors,
    until positives are about ``share`` of the others. What is drawn is a hash of the point, so it
    is the same on every run."""
    y = F.col(settings.target)
    minority = materialize(df.filter(y == 1).select(vector_to_array("features").alias("x")).withColumn("i", F.monotonically_increasing_id()))
    have, n = minority.count(), df.count()
    want = int(share * (n - have)) - have
    if have < 2 or want <= 0:
        return df.select("features", settings.target)
    near = nearest_others(minority, neighbours).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("place", "z"))).alias("all"))
    times = -(-want // have)
    drawn = lambda salt, n: F.pmod(F.xxhash64("i", "t", F.lit(settings.random_state + salt)), n)
    made = minority.join(near, "i").withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(times))))
    made = made.filter((F.col("t") < times) | (drawn(0, F.lit(1 << 20)) < F.lit(int((want / have - times + 1) * (1 << 20)))))
    made = made.withColumns({"to": F.element_at("all", (drawn(1, F.size("all").cast("long")) + 1).cast("int"))["z"], "u": drawn(2, F.lit(1 << 30)) / F.lit(float(1 << 30))})
    point = F.zip_with("x", "to", lambda a, b: a + F.col("u") * (b - a))
    return df.select("features", settings.target).unionByName(made.select(array_to_vector(point).alias("features"), F.lit(1).cast(df.schema[settings.target].dataType).alias(settings.target)))


def fit(spec: ModelSpec, train: DataFrame, prepared: Prepared | None = None, settings: Settings = DEFAULT) -> tuple[Prepared, PipelineModel]:
    prepared = replace(prepared or Prepared.fit(train), native=spec.kind == "boosted")
    ready = with_weight(prepared.transform(train), settings, spec.weighted).persist()
    try:
        n = ready.count()
        features = Pipeline(stages=prepared.stages(spec.kind == "logreg")).fit(ready)
        table = features.transform(ready)
        if spec.oversample:
            table = with_weight(oversampled(table, settings), settings, False)
        model = estimator(spec, n, settings).fit(table)
        return prepared, PipelineModel(stages=[*features.stages, model])
    finally:
        ready.unpersist()


def score(model: PipelineModel, prepared: Prepared, df: DataFrame, out: str = "score") -> DataFrame:
    """``df`` with the probability of a positive."""
    keep = df.columns
    return model.transform(prepared.transform(df)).withColumn(out, vector_to_array("probability")[1]).select(*keep, out)


def importances(model: PipelineModel, scored: DataFrame, top: int = 20) -> list[tuple[str, float]]:
    """(feature, importance) of the model's last stage, largest first."""
    attributes = scored.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a.get("name", str(a["idx"])) for group in attributes.values() for a in group}
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return sorted(((names.get(i, str(i)), float(v)) for i, v in enumerate(values)), key=lambda x: -x[1])[:top]


def leakage_check(found: list[tuple[str, float]], limit: float = 0.5) -> str | None:
    """The feature that holds more than ``limit`` of all importance, if one does."""
    total = sum(v for _, v in found)
    if total and found[0][1] / total > limit:
        log.warning("%s holds %.0f%% of the importance: check it for leakage", found[0][0], 100 * found[0][1] / total)
        return found[0][0]
    return None
