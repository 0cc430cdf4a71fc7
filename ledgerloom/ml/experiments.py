"""Compare, tune and finally evaluate models."""

from __future__ import annotations

import json
import logging
import time
from dataclasses import replace
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..errors import ModelUnavailableError
from ..functions.columns import micros
from ..operators import metrics
from ..operators.rules import apply_rules
from ..operators.windows import exact_quantiles
from ..scratch import materialize
from ..sources import runs
from .models import ModelSpec, Prepared, default_specs, fit, importances, leakage_check, score

log = logging.getLogger(__name__)


def rules_baseline(df: DataFrame, settings: Settings = DEFAULT) -> float | None:
    """The average precision that the rules' score has: what a model has to beat."""
    return metrics.average_precision(apply_rules(df, settings), "rule_score", settings).first()[0]


def evaluate(scored: DataFrame, baseline: float, settings: Settings = DEFAULT) -> dict:
    scored = scored.persist()
    try:
        out = metrics.headline(scored, baseline, settings=settings).first().asDict()
        for r in metrics.recall_at_k(scored, settings=settings).collect():
            out |= {f"caught_at_{r['k']}": r["caught"], f"recall_at_{r['k']}": r["recall"]}
        return out
    finally:
        scored.unpersist()


def prepared_for(train: DataFrame, model: PipelineModel) -> Prepared:
    """The preprocessing that goes with a loaded model: learned from the same rows."""
    return replace(Prepared.fit(train), native=isinstance(model.stages[-1], GBTClassificationModel))


def signature(prepared: Prepared) -> dict:
    """The columns a model takes, and what it gives."""
    return {"numeric": list(prepared.numeric), "boolean": list(prepared.boolean), "categorical": list(prepared.frequent), "output": {"score": "double"}}


def run_experiments(spark: SparkSession, train: DataFrame, val: DataFrame, store: str | None = None, specs: list[ModelSpec] | None = None, baseline: float | None = None, settings: Settings = DEFAULT) -> list[dict]:
    """Each model's figures on validation, best first; one whose library is missing is skipped.
    ``baseline`` is the rules' average precision on validation, if not given. Warns if the best is
    suspiciously good, and says so if none beats the rules."""
    prepared = Prepared.fit(train)
    baseline = rules_baseline(val, settings) if baseline is None else baseline
    out = []
    for spec in specs or default_specs():
        try:
            own, model = fit(spec, train, prepared, settings)
        except ModelUnavailableError as e:
            log.warning("%s is skipped: %s", spec.name, e)
            continue
        found = evaluate(score(model, own, val), baseline or 1.0, settings)
        top = importances(model, model.transform(own.transform(val)))
        leak = leakage_check(top)
        run = runs.log_run(spark, store, spec.name, "train", spec.params, found, model, signature(own)) if store else None
        out.append({"name": spec.name, "run_id": run, "leak": leak, "importances": top, "model": model, "prepared": own, "baseline": baseline, **found})
    out.sort(key=lambda r: -(r["pr_auc"] or 0.0))
    if out and (out[0]["pr_auc"] or 0) > 0.30:
        log.warning("a PR-AUC of %.3f is suspicious: look for leakage", out[0]["pr_auc"])
    if out and (out[0]["pr_auc"] or 0) < (baseline or 0.0):
        log.error("no model beats the rules")
    return out


def comparison(spark: SparkSession, found: list[dict]) -> DataFrame:
    """A row for each model and figure: name, metric, value."""
    rows = [(r["name"], k, float(v)) for r in found for k, v in r.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return spark.createDataFrame(rows, "name string, metric string, value double")


def importance_table(spark: SparkSession, found: list[dict]) -> DataFrame:
    rows = [(r["name"], place, feature, value) for r in found for place, (feature, value) in enumerate(r["importances"], 1)]
    return spark.createDataFrame(rows, "name string, place int, feature string, importance double")


def fold_cuts(df: DataFrame, n_splits: int = 3) -> list[int]:
    """Where the folds' training rows end: positions in time order, looked up as quantiles."""
    parts = n_splits + 1
    found = exact_quantiles(df.select(micros("timestamp").alias("us")), "us", [i / parts for i in range(1, parts)])
    return [int(c) for c in found if c is not None]


def expanding_folds(df: DataFrame, n_splits: int = 3) -> list[tuple[DataFrame, DataFrame]]:
    """(train, test) folds in order of time: each trains on all rows before its test rows; rows of one
    moment stay together."""
    us, cuts = micros("timestamp"), fold_cuts(df, n_splits)
    ends = [*cuts[1:], None]
    return [(df.filter(us <= a), df.filter(us > a) if b is None else df.filter((us > a) & (us <= b))) for a, b in zip(cuts, ends, strict=True)]


def grid(options: dict[str, list]) -> list[dict]:
    return [dict(zip(options, values, strict=True)) for values in product(*options.values())]


def tune(spec: ModelSpec, options: dict[str, list], train: DataFrame, n_splits: int = 3, settings: Settings = DEFAULT) -> list[dict]:
    """Mean and spread of the folds' average precision for each point of the grid, best first, with
    that on the folds' own training rows and the seconds of fitting and scoring."""
    folds = [(a.persist(), b.persist()) for a, b in expanding_folds(train, n_splits)]
    prepared = [Prepared.fit(a) for a, _ in folds]
    spread = lambda x: (sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x)) ** 0.5
    precision = lambda df: metrics.average_precision(df, settings=settings).first()[0] or 0.0
    rows = []
    try:
        for params in grid(options):
            own = ModelSpec(spec.name, spec.kind, spec.params | params, spec.weighted, spec.oversample)
            tests, trains, fits, scores = [], [], [], []
            for (a, b), ready in zip(folds, prepared, strict=True):
                began = time.perf_counter()
                fitted, model = fit(own, a, ready, settings)
                fits.append(time.perf_counter() - began)
                began = time.perf_counter()
                tests.append(precision(score(model, fitted, b)))
                scores.append(time.perf_counter() - began)
                trains.append(precision(score(model, fitted, a)))
            cells = {"mean_test_score": tests, "mean_train_score": trains, "mean_fit_time": fits, "mean_score_time": scores}
            rows.append({"params": own.params, "split_scores": tests, "std_test_score": spread(tests)} | {k: sum(v) / len(v) for k, v in cells.items()})
    finally:
        for a, b in folds:
            a.unpersist()
            b.unpersist()
    rows.sort(key=lambda r: -r["mean_test_score"])
    return [r | {"rank": i + 1} for i, r in enumerate(rows)]


def cv_results(spark: SparkSession, table: list[dict]) -> DataFrame:
    """``tune``'s table: rank, params, means, spread and the score of each split."""
    means = ("mean_test_score", "std_test_score", "mean_train_score", "mean_fit_time", "mean_score_time")
    n = max((len(r["split_scores"]) for r in table), default=0)
    rows = [(r["rank"], json.dumps(r["params"], sort_keys=True), *[float(r[m]) for m in means], *map(float, r["split_scores"])) for r in table]
    return spark.createDataFrame(rows, ", ".join(["rank int", "params string", *[f"{m} double" for m in means], *[f"split{i}_test_score double" for i in range(n)]]))


def run_tuning(spark: SparkSession, train: DataFrame, val: DataFrame, grids: dict[str, tuple[ModelSpec, dict]], store: str | None = None, n_splits: int = 3, settings: Settings = DEFAULT) -> list[dict]:
    """Tunes each model, refits the best point on all of train and scores validation with it."""
    out = []
    baseline = rules_baseline(val, settings)
    for name, (spec, options) in grids.items():
        table = tune(spec, options, train, n_splits, settings)
        best = ModelSpec(name, spec.kind, table[0]["params"], spec.weighted, spec.oversample)
        prepared, model = fit(best, train, None, settings)
        found = evaluate(score(model, prepared, val), baseline or 1.0, settings)
        if abs(table[0]["mean_test_score"] - (found["pr_auc"] or 0.0)) > 0.05:
            log.warning("%s: folds and validation differ by more than 0.05", name)
        run = runs.log_run(spark, store, name, "tune", best.params, found | {"cv_pr_auc": table[0]["mean_test_score"]}, model, signature(prepared)) if store else None
        out.append({"name": name, "run_id": run, "table": table, "model": model, "prepared": prepared, **found})
    return sorted(out, key=lambda r: -(r["pr_auc"] or 0.0))


def evaluate_on_test(model, prepared: Prepared, val: DataFrame, test: DataFrame, settings: Settings = DEFAULT) -> dict:
    """The final figures: the threshold is chosen on validation, the test set is scored once.
    ``tables`` has the reports: at k, against the rules, calibration, and by format and sender's type."""
    on_val = metrics.score_steps(metrics.score_counts(score(model, prepared, val), settings=settings))
    chosen = metrics.threshold_of(on_val, settings).first()
    keep = [c for c in ("payment_format", "src_entity_type") if c in test.columns]
    scored = materialize(apply_rules(score(model, prepared, test), settings).select("txn_id", settings.target, "score", "rule_score", *keep))
    point = metrics.operating_point(scored, chosen["threshold"], settings=settings).first().asDict()
    rules = metrics.average_precision(scored, "rule_score", settings).first()[0]
    out = metrics.headline(scored, rules or 1.0, settings=settings).first().asDict() | {"operating_point": point, "threshold": chosen["threshold"], "rules_pr_auc": rules}
    out["brier"] = metrics.brier(scored, settings=settings).first()[0]
    out["val_pr_auc"] = metrics.ap_of(on_val).first()[0]
    out["drop"] = (out["val_pr_auc"] or 0.0) - (out["pr_auc"] or 0.0)
    tables = {"recall_at_k": metrics.recall_at_k(scored, settings=settings), "vs_rules": metrics.model_vs_rules(scored, settings=settings), "calibration": metrics.calibration(scored, settings=settings).orderBy("bin")}
    for column in keep:
        tables[f"by_{column}"] = metrics.segment_recall(scored, column, chosen["threshold"], settings=settings).orderBy(F.desc("positives"))
    out["tables"] = tables
    out["blind"] = [r["segment"] for r in metrics.blind_segments(tables["by_payment_format"]).collect()] if "by_payment_format" in tables else []
    if out["drop"] > 0.05:
        log.warning("PR-AUC drops by %.3f from validation to test", out["drop"])
    if point["alerts"] < 10:
        log.warning("only %d alerts", point["alerts"])
    for segment in out["blind"]:
        log.warning("the model is blind to %s", segment)
    return out
