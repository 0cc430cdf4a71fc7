"""Operators against hand-made ledgers, brute force and metamorphic checks."""

import dataclasses
import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import config, errors, scratch
from ledgerloom.cli import ORDER, Stages, run_stages
from ledgerloom.functions import columns
from ledgerloom.ml import experiments, models
from ledgerloom.operators import clean, enrich, graph, history, metrics, profile, rules, split, stats, windows
from ledgerloom.sources import files, runs, settings, views
from ledgerloom.streaming import incremental

S = views.VIEW_SETTINGS
T0 = dt.datetime(2022, 9, 1)


def ledger(spark, rows):
    """(txn_id, minutes, src, dst, amount[, format[, label]])"""
    full = [(i, T0 + dt.timedelta(minutes=m), s, d, float(a), "USD", *(rest or ["ACH"]), *([0] if len(rest) < 2 else [])) for i, m, s, d, a, *rest in rows]
    return spark.createDataFrame(full, "txn_id long, timestamp timestamp, src_account string, dst_account string, amount_paid double, currency_paid string, payment_format string, is_laundering int")


def noisy(n=300, seed=0, accounts=8):
    rng = random.Random(seed)
    return [(i, rng.randrange(0, 60 * 24 * 9, 30), f"A{rng.randrange(accounts)}", f"A{rng.randrange(accounts)}", round(rng.lognormvariate(4, 1), 1)) for i in range(n)]


def brute_history(rows):
    out = {}
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    for k, (i, m, s, d, a) in enumerate(rows):
        sent, got = [r for r in rows[:k] if r[2] == s], [r for r in rows[:k] if r[3] == d]
        gap = lambda p: (m - p[-1][1]) * 60.0 if p else None
        out[i] = (len(sent), len(got), gap(sent), gap(got), len({r[3] for r in sent}), len({r[2] for r in got}), math.log1p(a) - sum(math.log1p(r[4]) for r in sent) / len(sent) if len(sent) >= 3 else None)
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_history_equals_brute_force_with_ties(spark, hot):
    rows = noisy()
    names = ["src_txn_count_prior", "dst_txn_count_prior", "src_secs_since_last", "dst_secs_since_last", "src_unique_dst_prior", "dst_unique_src_prior", "src_log_dev"]
    got = {r["txn_id"]: tuple(r[n] for n in names) for r in history.build_features(ledger(spark, rows), hot_accounts=hot).collect()}
    want = brute_history(rows)
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i][:6] == w[:6] and (got[i][6] is None) == (w[6] is None) and (w[6] is None or math.isclose(got[i][6], w[6], abs_tol=1e-9))


def test_history_guards_and_flags(spark):
    out = history.build_features(ledger(spark, noisy())).collect()
    for r in out:
        assert (r["src_fanout_ratio"] is None) == (r["src_txn_count_prior"] < 3) and (r["src_fanout_ratio"] is None or 0 <= r["src_fanout_ratio"] <= 1)
        assert r["src_rapid_txn"] == (r["src_secs_since_last"] is not None and r["src_secs_since_last"] <= 60)
        assert r["dst_high_fanin"] == (r["dst_fanin_ratio"] is not None and r["dst_fanin_ratio"] > 0.667)
        assert math.isclose(r["hour_sin"] ** 2 + r["hour_cos"] ** 2, 1.0)
    with pytest.raises(errors.LedgerSchemaError):
        history.account_features(ledger(spark, noisy(3)).drop("amount_paid"))


def test_average_rank_percentile(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0), ("b", 9.0), (None, 1.0), ("b", None)], "currency_paid string, amount_paid double")
    got = sorted(((r[0] or "", r[1] or 0, r[2]) for r in windows.with_pct_rank(df, "amount_paid", "currency_paid", "p").select("currency_paid", "amount_paid", "p").collect()), key=repr)
    assert got == sorted([("a", 1.0, 0.25), ("a", 2.0, 0.625), ("a", 2.0, 0.625), ("a", 5.0, 1.0), ("b", 9.0, 1.0), ("", 1.0, None), ("b", 0, None)], key=repr)


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 4, 10)], "x double")
    assert windows.exact_quantiles(df, "x", (0, 0.25, 0.5, 0.9, 1)) == [1.0, 2.0, 2.0, pytest.approx(7.6), 10.0]
    assert windows.exact_quantiles(df.limit(0), "x", (0.5,)) == [None]


def test_percentile_fitted_on_train_only(spark):
    df = ledger(spark, noisy(200))
    train = df.filter("txn_id < 100")
    one = history.fit_pct_rank(train, df).filter("txn_id = 150").first()["amt_pct_ccy"]
    other = history.fit_pct_rank(train, df.filter("txn_id in (150) or txn_id < 100")).filter("txn_id = 150").first()["amt_pct_ccy"]
    assert one == other and 0 <= one <= 1


def brute_nodes(rows, width):
    start = min(r[1] for r in rows)
    edges = [((r[1] - start) // 1440, *r[2:5]) for r in rows]
    out = {}
    for day in {e[0] for e in edges}:
        win = [e for e in edges if day - width <= e[0] < day]
        pairs = {(e[1], e[2]) for e in win}
        for node in {x for p in pairs for x in p}:
            into, sent = [e for e in win if e[2] == node], [e for e in win if e[1] == node]
            partners = {b for a, b in pairs if a == node} | {a for a, b in pairs if b == node}
            mutual = sum((b, a) in pairs for a, b in pairs if a == node) + sum((b, a) in pairs for a, b in pairs if b == node)
            total = sum(e[3] for e in into)
            out[node, day] = (
                len({e[1] for e in into}), len(into), total, max((e[3] for e in into), default=0), len({e[2] for e in sent}), len(sent), sum(e[3] for e in sent),
                sum(e[3] for e in sent) / (total + 1) if total else None, max((e[3] for e in into), default=0) / total if total else None, min(1, mutual / 2 / len(partners)),
            )
    return out


def test_node_table_equals_brute_force(spark):
    rows = [r for r in noisy(60, 3, 6) if r[1] // 1440 != 4] + [(900, 0, "Z", "Z", 5.0), (901, 10, "Z", "Y", 5.0)]
    made = graph.node_table(graph.with_day(ledger(spark, rows))).collect()
    names = ("in_degree", "txn_count_in", "amt_in_sum", "amt_in_max", "out_degree", "txn_count_out", "amt_out_sum", "flow_through", "amt_concentration", "reciprocity")
    for width in (1, 3, 7):
        got = {(r["node"], r["day"]): [r[f"{n}_{width}d"] for n in names] for r in made if r[f"in_degree_{width}d"] is not None}
        want = brute_nodes(rows, width)
        assert set(got) == set(want)
        for k, w in want.items():
            assert got[k] == [x if x is None else pytest.approx(x) for x in w]
    assert want["Z", 1][-1] == 0.5  # a self-loop is its own reverse


def test_hot_pairs_have_the_same_history(spark):
    rows = noisy(300, 7, 3)
    names = ("txn_id", "pair_txn_count_prior", "is_first_interaction", "pair_amt_log_dev")
    both = [sorted((r[0], r[1], r[2], None if r[3] is None else round(r[3], 9)) for r in graph.pair_features(ledger(spark, rows), hot_pairs=hot).select(*names).collect()) for hot in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 300
    with pytest.raises(errors.DuplicateAccountKeyError):
        enrich.require_unique(spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "node string, day int"), "node", "day")


def test_graph_sees_no_future(spark):
    rows = noisy(120, 5)
    columns = ["txn_id", *graph.model_inputs(graph.build_graph_features(ledger(spark, rows[:1])).columns)]
    assert len(columns) == 44
    early = [r for r in rows if r[1] < 5 * 1440]
    whole = {r["txn_id"]: r for r in graph.build_graph_features(ledger(spark, rows)).select(*columns).collect()}
    part = graph.build_graph_features(ledger(spark, early)).select(*columns).collect()
    assert len(part) == len(early)
    for r in part:
        for a, b in zip(r, whole[r["txn_id"]]):
            assert a == b or math.isclose(a, b, rel_tol=1e-9)


def test_clean_and_merge_from_files(spark, tmp_path):
    header = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"
    lines = [header, "2022/09/01 00:20,010,8000EBD30,10,8000EBD30,3697.34,US Dollar,3697.34,US Dollar,Reinvestment,0", "2022/09/04 00:20,3208,A,1,B,0.01,Euro,0.02,US Dollar,ACH,1", "2022/09/12 00:00,1,A,1,B,1,Euro,1,Euro,ACH,1"]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    out = clean.clean(files.read_transactions(spark, str(tmp_path / "t.csv"))).orderBy("timestamp").collect()
    assert [(r["src_account"], r["is_self_loop"], r["is_cross_currency"], r["is_burn_in"]) for r in out] == [("10_8000EBD30", True, False, True), ("3208_A", False, True, False)]
    (tmp_path / "a.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nPortugal Bank #4507,10,8000EBD30,E1,Corporation #33520\nNational Bank of X,1,B,E2,Trust #2\n")
    dim = enrich.clean_accounts(files.read_accounts(spark, str(tmp_path / "a.csv")))
    assert {tuple(r) for r in dim.collect()} == {("10_8000EBD30", "Corporation", "Portugal"), ("1_B", "Other", "Named")}
    both = enrich.merge_accounts(clean.clean(files.read_transactions(spark, str(tmp_path / "t.csv"))), dim)
    assert both.count() == 2 and both.filter("src_entity_type is null").count() == 1
    with pytest.raises(errors.DuplicateAccountKeyError):
        enrich.merge_accounts(both, dim.union(dim))
    with pytest.raises(errors.LedgerNotFoundError):
        files.read_transactions(spark, str(tmp_path / "none.csv"))
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(errors.LedgerSchemaError):
        files.read_transactions(spark, str(tmp_path / "bad.csv"))


def test_splits(spark, tmp_path):
    rows = [(i, i * 60, f"A{i % 5}", "B", 1.0, "ACH" if i % 4 else "Wire", int(i % 10 == 0)) for i in range(200)]
    df = clean.flag_burn_in(clean.flag_self_loops(ledger(spark, rows)))
    made = split.build_splits(df)
    found = split.validate_splits(made)
    assert found["train"]["end_us"] < found["val"]["start_us"] and made.filter("split = 'test'").count() == 40
    assert made.filter("split <> 'test' and (payment_format = 'Wire' or is_burn_in)").count() == 0
    assert split.build_splits(df, drop_burn_in=False).filter("is_burn_in").count() > 0
    with pytest.raises(errors.SplitError):
        split.validate_splits(made.filter("split <> 'val'"))
    with pytest.raises(errors.SplitError):
        split.validate_splits(made.withColumn("is_laundering", F.lit(0)))
    files.write_splits(made, str(tmp_path / "s"))
    assert files.read_split(spark, str(tmp_path / "s"), "val").count() == found["val"]["rows"]
    with pytest.raises(errors.SplitError):
        files.read_split(spark, str(tmp_path / "s"), "none")


def scores(spark):
    return spark.createDataFrame([(i, s, y, "x" if i % 2 else None) for i, (s, y) in enumerate(zip((0.9, 0.8, 0.7, 0.6, 0.6, 0.1), (1, 0, 1, 0, 1, 0)))], "txn_id long, score double, is_laundering int, seg string")


def test_metric_goldens(spark):
    df = scores(spark)
    assert metrics.average_precision(df).first()[0] == pytest.approx(0.755556, abs=1e-6)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(0.722222, abs=1e-6)
    assert metrics.choose_threshold(df).first()["threshold"] == 0.7
    assert metrics.operating_point(df, 0.7).first()["alerts_per_catch"] == 1.5
    assert metrics.segment_recall(df, "seg", 0.5).count() == 1
    assert [r["k"] for r in metrics.recall_at_k(df, ks=(2, 500, 1000)).collect()] == [2, 6]
    none = df.withColumn("is_laundering", F.lit(0))
    assert metrics.average_precision(none).first()[0] is None and metrics.operating_point(none, 0.7).first()["recall"] is None


def test_rules_ignore_missing_values(spark):
    df = spark.createDataFrame([(None, None, float("nan"), None, "Wire", None, 0)], "amt_pct_ccy double, src_secs_since_last double, dst_fanin_ratio double, src_log_dev double, payment_format string, hour int, is_laundering int")
    assert rules.apply_rules(df).first()["rule_score"] == 0
    assert rules.individual_rules(rules.apply_rules(df)).filter("precision is not null").count() == 0
    assert len(rules.without("high_fanin")) == 6


def test_statistics(spark):
    assert stats.chi2_yates((10, 20, 30, 40))[0] == pytest.approx(0.4464286, abs=1e-6)
    assert stats.fisher_exact((8, 2, 1, 5)) == (20.0, pytest.approx(0.0349650, abs=1e-6))
    assert stats.strong_pairs(stats.spearman(ledger(spark, noisy(50)).withColumn("b", F.col("amount_paid") * 2), ("amount_paid", "b"))).first()["r"] == pytest.approx(1.0)
    described = profile.transposed(profile.numeric_describe(ledger(spark, noisy(50)), "amount_paid"))
    assert described.filter("statistic = 'count'").first()["0"] == 50


def test_models_rank_better_than_chance(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        bad = rng.random() < 0.2
        rows.append((i, i * 20, f"A{rng.randrange(20)}", f"B{rng.randrange(20)}", rng.lognormvariate(9 if bad else 5, 0.5), "ACH" if bad else rng.choice(["Wire", "ACH", "Cash"]), int(bad)))
    df = history.build_features(ledger(spark, rows)).persist()
    train, val = df.filter("txn_id < 400"), df.filter("txn_id >= 400")
    specs = [models.ModelSpec("logreg", "logreg", {"max_iter": 15}), models.ModelSpec("boosted", "boosted", {"rounds": 4, "depth": 3}), models.ModelSpec("logreg_smote", "logreg", {"max_iter": 15}, False, True)]
    store = str(tmp_path / "store")
    found = experiments.run_experiments(spark, train, val, store, specs)
    assert len(found) == 3 and found[0]["pr_auc"] > 0.6
    assert found[0]["baseline"] == pytest.approx(experiments.rules_baseline(val)) and found[0]["vs_baseline"] == pytest.approx(found[0]["pr_auc"] / found[0]["baseline"])
    best = runs.best_run(spark, store)
    assert "smote" not in best["name"]
    loaded = runs.load_model(store, best["run_id"])
    prepared = experiments.prepared_for(train, loaded)
    out = experiments.evaluate_on_test(loaded, prepared, val, val)
    assert out["drop"] == pytest.approx(0.0) and out["operating_point"]["recall"] >= 0.6
    assert set(out["tables"]) == {"recall_at_k", "vs_rules", "calibration", "by_payment_format"}
    assert [runs.register_model(spark, store, "m", best["run_id"], experiments.signature(prepared), val.select(*prepared.numeric)) for _ in range(2)] == [1, 2]
    kept = runs.registered_model(spark, store, "m")
    assert kept["version"] == 2 and len(kept["example"]) == 5 and json.loads(kept["signature"])["numeric"] == list(prepared.numeric)
    assert runs.registered_model(spark, store, "other") is None
    skipped = experiments.run_experiments(spark, train, val, None, [models.ModelSpec("x", "xgboost"), specs[0]], 0.0)
    assert [r["name"] for r in skipped] == ["logreg"]
    with pytest.raises(ValueError):
        experiments.run_experiments(spark, train, val, None, [models.ModelSpec("x", "unheard of")], 0.0)
    folds = experiments.expanding_folds(train, 3)
    assert [a.count() for a, _ in folds] == sorted(a.count() for a, _ in folds) and sum(b.count() for _, b in folds) + folds[0][0].count() == 400
    table = experiments.tune(specs[0], {"C": [0.1, 1.0]}, train, 2)
    assert experiments.cv_results(spark, table).columns[-2:] == ["split0_test_score", "split1_test_score"]
    assert [r["rank"] for r in table] == [1, 2] and table[0]["mean_test_score"] >= table[1]["mean_test_score"]


def test_streams_equal_batch(spark, tmp_path):
    rows = noisy(80)
    df = ledger(spark, rows)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    sides = {"src": ("dst", 0, 4, 2), "dst": ("src", 1, 5, 3)}
    for side, (other, count, partners, gap) in sides.items():
        q = incremental.prior_features(stream, side, forget="900 days").writeStream.format("memory").queryName(f"prior_{side}").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        got = {r["txn_id"]: (r[f"{side}_txn_count_prior"], r[f"{side}_unique_{other}_prior"], r[f"{side}_secs_since_last"]) for r in spark.table(f"prior_{side}").collect()}
        assert got == {i: (w[count], w[partners], w[gap]) for i, w in brute_history(rows).items()}
    first = min(r[1] for r in rows)  # minutes after T0, which is a midnight
    q = incremental.hopping_counts(stream, 3, origin=f"{first % 1440} minutes").writeStream.format("memory").queryName("hops").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hops").agg(F.sum("n")).first()[0] == 3 * len(rows)
    days = {(r["account"], (r["day"] - T0 - dt.timedelta(minutes=first)).days): (r["n"], r["partners"], pytest.approx(r["amount"])) for r in spark.table("hops").collect()}
    nodes = graph.node_table(graph.with_day(df), (3,)).filter("txn_count_in_3d > 0").collect()
    assert nodes and all(days[r["node"], r["day"]] == (r["txn_count_in_3d"], r["in_degree_3d"], r["amt_in_sum_3d"]) for r in nodes)


def test_streams_forget_idle_accounts(spark, tmp_path):
    df = ledger(spark, [(0, 0, "A", "B", 1.0), (1, 10, "A", "C", 1.0)])
    later = ledger(spark, [(2, 60 * 24 * 40, "Z", "B", 1.0)])
    again = ledger(spark, [(3, 60 * 24 * 80, "A", "C", 1.0)])
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(df.schema).parquet(source)
    for i, part in enumerate((df, later, later.withColumn("txn_id", F.lit(9).cast("long")), again)):
        part.coalesce(1).write.mode("append").parquet(source)
        q = incremental.prior_features(stream, forget="10 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    got = {r["txn_id"]: r["src_txn_count_prior"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 9: 1, 3: 0}


def test_stages_run_once(spark, tmp_path):
    rng = random.Random(2)
    (tmp_path / "data/raw").mkdir(parents=True)
    lines = ["Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"]
    for i in range(400):
        at = T0 + dt.timedelta(minutes=i * 30)
        lines.append(f"{at:%Y/%m/%d %H:%M},{rng.randrange(3)},A{rng.randrange(9)},{rng.randrange(3)},B{rng.randrange(9)},{i}.5,Euro,{i}.5,Euro,{rng.choice(['ACH', 'Cash'])},{int(rng.random() < 0.2)}")
    (tmp_path / "data/raw/transactions.csv").write_text("\n".join(lines))
    (tmp_path / "data/raw/accounts.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nX Bank #1,0,A1,E,Individual #1\n")
    (tmp_path / "params.json").write_text(json.dumps({"tuning": {"n_splits": 2, "scoring": "average_precision", "grids": {"logreg": {"C": [0.1], "max_iter": [5]}}}}))
    specs = [models.ModelSpec("logreg", "logreg", {"max_iter": 10}), models.ModelSpec("boosted", "boosted", {"rounds": 2, "depth": 2})]
    stages = Stages(spark, str(tmp_path), specs=specs)
    names = list(ORDER)
    with pytest.raises(errors.NoRunError):
        stages.evaluate()
    files.write_pointer(spark, stages.at("raw", "transactions.csv"))
    assert run_stages(stages, names) == names and run_stages(stages, names) == []
    changed = Stages(spark, str(tmp_path), dataclasses.replace(config.DEFAULT, target_recall=0.5), specs)
    assert run_stages(changed, ["evaluate"]) == ["evaluate"]
    for report in ("comparison", "importances", "cv_results_logreg", "test_by_payment_format", "test_by_src_entity_type", "test_calibration", "test_recall_at_k", "test_vs_rules"):
        assert files.read_report(spark, stages.at("reports", report)).count() > 0, report
    prepared = models.Prepared.fit(stages.part("train"))
    assert len(prepared.numeric) + len(prepared.boolean) + len(prepared.frequent) == 59
    assert files.read_metrics(spark, stages.at("reports", "dropped_tail.json"))["rows"] == 400
    assert runs.registered_model(spark, stages.at("models", "store"), "ledger_model")["version"] >= 1
    assert files.read_report(spark, stages.at("reports", "baseline_individual")).count() == 7
    assert stages.part("train").columns[-1] == "split" and len(graph.model_inputs(stages.part("val").columns)) == 43


def test_settings_and_files(spark, tmp_path):
    path = tmp_path / "params.json"
    path.write_text(json.dumps({"tuning": {"n_splits": 3, "scoring": "average_precision", "grids": {}}}))
    assert settings.load_tuning(str(path))["n_splits"] == 3
    path.write_text(json.dumps({"tuning": {"n_splits": 3}}))
    for bad in (path, tmp_path / "none.json"):
        with pytest.raises(errors.TuningError):
            settings.load_tuning(str(bad))
    file = files.write_metrics(spark, {"a": 1.5}, str(tmp_path / "m/x.json"))
    assert files.read_metrics(spark, file) == {"a": 1.5} and not files.verify_pointer(spark, file)
    files.write_pointer(spark, file)
    assert files.verify_pointer(spark, file)
    files.write_metrics(spark, {"a": 2}, file)
    with pytest.raises(errors.LedgerSchemaError):
        files.verify_pointer(spark, file)
    files.write_report(scores(spark), str(tmp_path / "r"))
    assert files.read_report(spark, str(tmp_path / "r")).count() == 6


def test_ids_keep_the_order_of_files(spark, tmp_path):
    header = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"
    for k, name in enumerate("ab c"):
        rows = [f"2022/09/01 00:20,1,A{i % 5},2,B,{1000 * k + i}.0,Euro,{1000 * k + i}.0,Euro,ACH,{i % 2}" for i in range(400)]
        (tmp_path / f"{k}{name}.csv").write_text("\n".join([header, *rows]) + "\n")
    small = {"spark.sql.files.maxPartitionBytes": "5000", "spark.sql.files.openCostInBytes": "10"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        for path, n in ((tmp_path, 1600), (tmp_path / "0a.csv", 400)):
            df = files.read_transactions(spark, str(path))
            assert df.rdd.getNumPartitions() > 3
            found = [r["amount_paid"] for r in sorted(df.collect(), key=lambda r: r["txn_id"])]
            assert found == sorted(found) and df.select("txn_id").distinct().count() == n
        bare = files.read_transactions(spark, str(tmp_path)).drop("txn_id")
        one, two = clean.add_txn_id(bare.union(bare)), clean.add_txn_id(bare.repartition(5).union(bare))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.select("txn_id").distinct().count() == 3200
        made = clean.clean(bare.repartition(4)).withColumn("score", F.lit(1.0))  # ids of all sizes
        assert made.agg(F.max("txn_id")).first()[0] > 1 << 60
        assert metrics.recall_at_k(made, ks=(10,)).first()["k"] == 10 and rules.precision_at_k(made.withColumn("rule_score", F.lit(1)), (10,)).count() == 1
        gone = clean.tail_summary(clean.parse_timestamp(bare)).first()
        assert (gone["rows"], gone["dropped"], gone["dropped_rate"]) == (1600, 0, None)
    finally:
        for k in small:
            spark.conf.unset(k)


def test_rows_are_counted_after_joins(spark):
    df = spark.range(5)
    assert enrich.require_same_rows(df, df) is df
    with pytest.raises(errors.RowCountError):
        enrich.require_same_rows(df, df.union(df))


def test_small_tools(spark):
    df = spark.createDataFrame([("Portugal Bank #4507",), ("no number",), (None,), ("#x #12",)], "s string")
    assert [r[0] for r in df.select(columns.number_after(F.col("s"))).collect()] == [4507.0, None, None, 12.0]
    rows = ledger(spark, [(i, i, "A", "B", 1.0, "ACH", int(i % 5 == 0)) for i in range(100)])
    sampled = profile.sample_for_plots(rows, 30)
    assert sampled.count() == 50 and sampled.collect() == profile.sample_for_plots(rows, 30).collect()
    assert split.two_way(rows).filter("split = 'fit'").count() == 70
    faults = {r["split"]: tuple(r)[1:] for r in split.split_faults(split.with_split(rows)).collect()}
    assert faults == {"train": (False, True, False), "val": (False, True, False), "test": (False, True, False)}
    mixed = split.with_split(rows).withColumn("split", F.when(F.col("txn_id") == 99, "train").otherwise(F.col("split")))
    assert {r["split"] for r in split.split_faults(mixed).filter("overlaps_next").collect()} == {"train"}


def test_vif_equals_regressions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    x[:, 2] += 0.8 * x[:, 0]
    got = {r["column"]: r["vif"] for r in stats.vif(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double"), ("a", "b", "c")).collect()}
    for i, c in enumerate("abc"):
        others = np.column_stack([np.ones(300), np.delete(x, i, 1)])
        left = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        assert got[c] == pytest.approx(((x[:, i] - x[:, i].mean()) ** 2).sum() / (left**2).sum())
    same = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "a double, b double")
    assert [r["vif"] for r in stats.vif(same, ("a", "b")).collect()] == [None, None]


def test_running_sums_over_many_ranges(spark):
    rng = random.Random(8)
    values = sorted({(g, rng.randrange(10**6)) for g in "aaab" for _ in range(800)})
    table = scratch.materialize(spark.createDataFrame([(g, v, rng.randrange(5)) for g, v in values], "g string, v long, w long"))
    for by in ([], ["g"]):
        whole = {(r["g"], r["v"]): r["s"] for r in windows.prefix_sums(table, by, "v", {"w": "s"}).collect()} if by else None
        some = {(r["g"], r["v"]): r["s"] for r in windows.prefix_sums(table, by, "v", {"w": "s"}, bucket_rows=100).collect()} if by else None
        if by:
            assert whole == some
    distinct = scratch.materialize(table.groupBy("v").agg(F.sum("w").alias("w")))
    got = [[tuple(r) for r in windows.prefix_sums(distinct, [], "v", {"w": "s"}, bucket_rows=n).orderBy("v").collect()] for n in (100, 1 << 20)]
    assert got[0] == got[1] and got[0][-1][2] == sum(r[1] for r in got[0])


def test_fisher_sums_from_the_mode():
    def whole(a, b, c, d):
        row, column, n = a + b, a + c, a + b + c + d
        weights = [math.comb(row, k) * math.comb(n - row, column - k) for k in range(max(0, column - n + row), min(row, column) + 1)]
        own = math.comb(row, a) * math.comb(n - row, column - a)
        return sum(w for w in weights if w <= own * (1 + 1e-9)) / math.comb(n, column)

    rng = random.Random(1)
    for _ in range(300):
        table = tuple(rng.randrange(0, 30) for _ in range(4))
        assert stats.fisher_exact(table)[1] == pytest.approx(whole(*table), rel=1e-7)
    assert 0 <= stats.fisher_exact((5_000_000, 5_100_000, 5_050_000, 4_990_000))[1] < 1e-9


def test_neighbours_of_any_number_of_points(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(60, 3)), 1)
    points = scratch.materialize(spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "i long, x array<double>").repartition(4))
    want = {(i, p + 1): list(x[j]) for i in range(60) for p, j in enumerate(sorted((j for j in range(60) if j != i), key=lambda j: (round(((x[i] - x[j]) ** 2).sum(), 9), j))[:5])}
    for block_bytes in (8 << 20, 200):
        found = models.nearest_others(points, 5, block_bytes).collect()
        distance = lambda i, z: round(float(((x[i] - np.array(z)) ** 2).sum()), 9)
        assert {(r["i"], r["place"]): distance(r["i"], r["z"]) for r in found} == {k: distance(k[0], z) for k, z in want.items()}


def test_logreg_scores_are_the_production_model(spark, sf_dir, monkeypatch):
    from ledgerloom.plans import registry

    seen, real = [], models.fit

    def fit(spec, *rest, **more):
        prepared, model = real(spec, *rest, **more)
        seen.append((spec, model.stages[-1].getMaxIter()))
        return prepared, model

    monkeypatch.setattr(models, "fit", fit)
    registry.QUERIES["logreg_scores"](spark, sf_dir)
    assert seen == [(models.default_specs()[0], 1000)]
