"""Stages from raw files to an evaluated model, each skipped if its inputs haven't changed.

    python -m ledgerloom.cli STAGE... [--root DIR] [--force] [--hot-accounts]
"""

from __future__ import annotations

import argparse
import hashlib
import json
import logging
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import scratch
from .config import DEFAULT, Settings
from .errors import NoRunError
from .ml import experiments
from .operators import clean, enrich, graph, history, rules, split
from .session import build_session
from .sources import files, runs, store

log = logging.getLogger(__name__)


CODE = Path(__file__).parent


def fingerprint(spark: SparkSession, paths: list[str], settings: Settings) -> str:
    """Hash of names, sizes and times of all files below the paths, on any file system, of the
    settings and of the engine's code: a stage runs anew if one of them changes."""
    code = [(str(f.relative_to(CODE)), hashlib.sha256(f.read_bytes()).hexdigest()) for f in sorted(CODE.rglob("*.py"))]
    found = [store.files_below(spark, p) for p in paths]
    return hashlib.sha256(json.dumps([found, asdict(settings), code]).encode()).hexdigest()


class Stages:
    """The stages over one root folder. ``specs``: the models to compare; ``tuning``: the file with the
    grids, ``params.yaml`` or ``params.json`` of the root by default; ``hot_accounts``: no task
    holds all rows of an account or pair."""

    def __init__(self, spark: SparkSession, root: str = ".", settings: Settings = DEFAULT, specs: list | None = None, tuning: str | None = None, hot_accounts: bool = False):
        self.spark, self.root, self.settings, self.specs, self.hot_accounts = spark, root, settings, specs, hot_accounts
        self.tuning = tuning or next((f"{root}/{n}" for n in ("params.yaml", "params.yml") if store.exists(spark, f"{root}/{n}")), f"{root}/params.json")

    def at(self, kind: str, name: str) -> str:
        return f"{self.root.rstrip('/')}/{self.settings.paths[kind]}/{name}"

    def clean(self) -> None:
        path = self.at("raw", "transactions.csv")
        files.verify_pointer(self.spark, path)
        raw = files.read_transactions(self.spark, path)
        gone = clean.tail_summary(clean.parse_timestamp(raw), self.settings).first()
        log.info("%d of %d rows are after the simulation's end, %d of them positive", gone["dropped"], gone["rows"], gone["dropped_positives"])
        files.write_metrics(self.spark, gone.asDict(), self.at("reports", "dropped_tail.json"))
        files.write_stage(clean.clean(raw, self.settings), self.at("interim", "cleaned"))

    def merge(self) -> None:
        path = self.at("raw", "accounts.csv")
        files.verify_pointer(self.spark, path)
        dim = enrich.clean_accounts(files.read_accounts(self.spark, path), self.settings)
        before = files.read_stage(self.spark, self.at("interim", "cleaned"))
        files.write_stage(enrich.merge_accounts(before, dim), self.at("interim", "merged"))
        enrich.require_same_rows(before, files.read_stage(self.spark, self.at("interim", "merged")), "merge")

    def features(self) -> None:
        files.write_stage(history.build_features(files.read_stage(self.spark, self.at("interim", "merged")), self.settings, self.hot_accounts), self.at("interim", "features"))

    def graph(self) -> None:
        before = files.read_stage(self.spark, self.at("interim", "features"))
        files.write_stage(graph.build_graph_features(before, self.settings, self.hot_accounts, validate=True), self.at("interim", "graph"), small=True)
        enrich.require_same_rows(before, files.read_stage(self.spark, self.at("interim", "graph")), "graph")

    def split(self) -> None:
        parted = split.build_splits(files.read_stage(self.spark, self.at("interim", "graph")), self.settings)
        split.validate_splits(parted, self.settings)
        files.write_splits(parted, self.at("processed", "splits"))

    def part(self, name: str):
        return files.read_split(self.spark, self.at("processed", "splits"), name)

    def report(self, table: DataFrame, name: str) -> None:
        files.write_report(table, self.at("reports", name))

    def baseline(self) -> None:
        for name, table in rules.baseline_report(self.part("val"), self.settings).items():
            self.report(table, f"baseline_{name}")

    def train(self) -> None:
        found = experiments.run_experiments(self.spark, self.part("train"), self.part("val"), self.at("models", "store"), self.specs, settings=self.settings)
        files.write_metrics(self.spark, {r["name"]: {k: v for k, v in r.items() if isinstance(v, (int, float))} for r in found}, self.at("reports", "metrics.json"))
        self.report(experiments.comparison(self.spark, found), "comparison")
        self.report(experiments.importance_table(self.spark, found), "importances")

    def tune(self) -> None:
        from .sources.settings import load_tuning

        given = load_tuning(self.tuning)
        specs = {s.kind: s for s in experiments.default_specs() if not s.oversample}
        grids = {kind: (specs[kind], options) for kind, options in given["grids"].items()}
        found = experiments.run_tuning(self.spark, self.part("train"), self.part("val"), grids, self.at("models", "store"), given["n_splits"], self.settings)
        files.write_metrics(self.spark, {r["name"]: r["table"] for r in found}, self.at("reports", "tuning_metrics.json"))
        for r in found:
            self.report(experiments.cv_results(self.spark, r["table"]), f"cv_results_{r['name']}")

    def evaluate(self) -> None:
        models = self.at("models", "store")
        best = runs.best_run(self.spark, models) if store.exists(self.spark, f"{models}/runs") else None
        if best is None:
            raise NoRunError(f"{models} has no run to evaluate: train first")
        prepared = experiments.prepared_for(self.part("train"), runs.load_model(models, best["run_id"]))
        found = experiments.evaluate_on_test(runs.load_model(models, best["run_id"]), prepared, self.part("val"), self.part("test"), self.settings)
        for name, table in found.pop("tables").items():
            self.report(table, f"test_{name}")
        files.write_metrics(self.spark, found, self.at("reports", "test_metrics.json"))
        runs.register_model(self.spark, models, "ledger_model", best["run_id"], experiments.signature(prepared), self.part("val").select(*prepared.numeric, *prepared.boolean, *prepared.frequent))


#: Stage, and what it reads.
ORDER: dict[str, list[tuple[str, str]]] = {
    "clean": [("raw", "transactions.csv")], "merge": [("interim", "cleaned"), ("raw", "accounts.csv")], "features": [("interim", "merged")], "graph": [("interim", "features")],
    "split": [("interim", "graph")], "baseline": [("processed", "splits")], "train": [("processed", "splits")], "tune": [("processed", "splits")], "evaluate": [("processed", "splits"), ("models", "store/runs")],
}


def run_stages(stages: Stages, names: list[str], force: bool = False) -> list[str]:
    """The stages that ran; one whose inputs, settings and code are those of its last run is skipped."""
    spark, done_path = stages.spark, f"{stages.root}/.stages.json"
    done = json.loads(store.read_text(spark, done_path)) if store.exists(spark, done_path) else {}
    ran = []
    for name in names:
        now = fingerprint(spark, [stages.at(*p) for p in ORDER[name]] + ([stages.tuning] if name == "tune" else []), stages.settings)
        if not force and done.get(name) == now:
            continue
        stage: Callable[[], None] = getattr(stages, name)
        stage()
        done[name] = now
        ran.append(name)
        store.write_text(spark, done_path, json.dumps(done))
    return ran


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("stages", nargs="+", choices=list(ORDER))
    parser.add_argument("--root", default=".")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--hot-accounts", action="store_true", help="cut accounts by time, for ledgers in which one holds many rows")
    args = parser.parse_args()
    spark = build_session()
    try:
        print(run_stages(Stages(spark, args.root, hot_accounts=args.hot_accounts), args.stages, args.force))
    finally:
        scratch.clear(spark)


if __name__ == "__main__":
    main()
