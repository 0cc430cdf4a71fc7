"""Auditable rules: each is a boolean expression; a missing input never fires."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import flag, known, ratio, tie_break
from ..scratch import materialize

log = logging.getLogger(__name__)
Rule = Callable[[Settings], Column]

RULES: dict[str, Rule] = {
    "high_risk_format": lambda s: F.col("payment_format").isin(*s.high_risk_formats),
    "structuring_band": lambda s: known(F.col("amt_pct_ccy")).between(*s.band),
    "rapid_passthrough": lambda s: known(F.col("src_secs_since_last")) <= s.rapid_seconds,
    "dormant_reactivation": lambda s: known(F.col("src_secs_since_last")) > s.dormant_seconds,
    "high_fanin": lambda s: known(F.col("dst_fanin_ratio")) > s.fanin_ratio,
    "amount_spike": lambda s: known(F.col("src_log_dev")) > s.spike_log_dev,
    "business_hours": lambda s: F.col("hour").between(*s.business_hours),
}


def apply_rules(df: DataFrame, settings: Settings = DEFAULT, rules: dict[str, Rule] | None = None) -> DataFrame:
    """``df`` with a flag for each rule, rule_score (how many fire) and any_rule."""
    rules = RULES if rules is None else rules
    df = df.withColumns({name: flag(rule(settings)) for name, rule in rules.items()})
    score = reduce(lambda a, b: a + b, [F.col(n).cast("int") for n in rules], F.lit(0))
    return df.withColumn("rule_score", score.cast("int")).withColumn("any_rule", F.col("rule_score") > 0)


def without(*names: str) -> dict[str, Rule]:
    """The registry less some rules."""
    return {n: r for n, r in RULES.items() if n not in names}


def effects(n: Column, fired: Column, caught: Column, positives: Column) -> dict[str, Column]:
    """precision, recall and lift; NULL where nothing fired or nothing is positive."""
    precision = ratio(caught, fired)
    return {"precision": precision, "recall": ratio(caught, positives), "lift": precision / F.nullif(ratio(positives, n), F.lit(0.0))}


def individual_rules(flagged: DataFrame, settings: Settings = DEFAULT, rules: dict[str, Rule] | None = None) -> DataFrame:
    """rule, fired, fired_pct, caught, precision, recall, lift; all rules in one pass."""
    names = list(RULES if rules is None else rules)
    y = F.col(settings.target) == 1
    cells = [F.count(F.lit(1)).alias("n"), F.sum(y.cast("long")).alias("pos")]
    for i, name in enumerate(names):
        cells += [F.sum(F.col(name).cast("long")).alias(f"f{i}"), F.sum((F.col(name) & y).cast("long")).alias(f"c{i}")]
    one = flagged.agg(*cells)
    stacked = one.select("n", "pos", F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.col(f"f{i}").alias("fired"), F.col(f"c{i}").alias("caught")) for i, x in enumerate(names)])).alias("r")).select("n", "pos", "r.*")
    out = effects(F.col("n"), F.col("fired"), F.col("caught"), F.col("pos"))
    return stacked.select("rule", "fired", ratio(F.col("fired"), F.col("n")).alias("fired_pct"), "caught", *[c.alias(k) for k, c in out.items()])


def combined_rules(flagged: DataFrame, settings: Settings = DEFAULT, rules: dict[str, Rule] | None = None) -> DataFrame:
    """threshold, alerts, alert_rate, caught, precision, recall, lift for ``score >= threshold``."""
    most = len(RULES if rules is None else rules)
    y = F.col(settings.target) == 1
    one = flagged.agg(
        F.count(F.lit(1)).alias("n"), F.sum(y.cast("long")).alias("pos"),
        *[c for t in range(1, most + 1) for hit in [F.col("rule_score") >= t] for c in (F.sum(hit.cast("long")).alias(f"a{t}"), F.sum((hit & y).cast("long")).alias(f"c{t}"))],
    )
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"a{t}").alias("alerts"), F.col(f"c{t}").alias("caught")) for t in range(1, most + 1)])
    stacked = one.select("n", "pos", F.explode(rows).alias("r")).select("n", "pos", "r.*")
    out = effects(F.col("n"), F.col("alerts"), F.col("caught"), F.col("pos"))
    return stacked.select("threshold", "alerts", ratio(F.col("alerts"), F.col("n")).alias("alert_rate"), "caught", *[c.alias(k) for k, c in out.items()])


def ranking(df: DataFrame, *scores: str, settings: Settings = DEFAULT, key: str = "txn_id") -> DataFrame:
    """A table of keys, scores and labels: all that a ranking is judged by, computed once."""
    return materialize(df.select(key, settings.target, *scores))


def label_totals(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(settings.target).cast("long")).alias("pos"))


def top_k(table: DataFrame, score: str, ks, settings: Settings = DEFAULT, key: str = "txn_id") -> DataFrame:
    """(k, caught) among the k highest scores of a ``ranking``, k at most the number of rows; ties go
    by a fixed pseudo-random order. Only the largest k rows are ever ranked."""
    n = table.count()
    ks = sorted({min(k, n) for k in ks})
    order = [F.desc(score), tie_break(F.col(key), settings.random_state), F.col(key)]
    best = table.select(score, key, F.col(settings.target).cast("long").alias("__y")).orderBy(*order).limit(max(ks, default=0))
    ranked = best.withColumn("__rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    cells = ranked.agg(*[F.coalesce(F.sum(F.when(F.col("__rank") <= k, F.col("__y"))), F.lit(0)).alias(f"k{k}") for k in ks])
    return cells.select(F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"k{k}").alias("caught")) for k in ks])).alias("r")).select("r.*")


def precision_at_k(flagged: DataFrame, ks=None, settings: Settings = DEFAULT, score: str = "rule_score") -> DataFrame:
    """k, caught, precision_at_k, recall_at_k, lift."""
    own = ranking(flagged, score, settings=settings)
    found = top_k(own, score, ks or settings.rule_k_values, settings)
    out = effects(F.col("n"), F.col("k"), F.col("caught"), F.col("pos"))
    return found.crossJoin(F.broadcast(label_totals(own, settings))).select("k", "caught", out["precision"].alias("precision_at_k"), out["recall"].alias("recall_at_k"), out["lift"].alias("lift"))


WEAK_LIFT = 1.2


def baseline_report(df: DataFrame, settings: Settings = DEFAULT, rules: dict[str, Rule] | None = None) -> dict[str, DataFrame]:
    """The three tables and the weak rules, from one evaluation of the flags; says which are weak."""
    names = list(RULES if rules is None else rules)
    flagged = materialize(apply_rules(df, settings, rules).select("txn_id", settings.target, *names, "rule_score", "any_rule"))
    single = individual_rules(flagged, settings, rules)
    weak = single.filter(F.col("lift") < WEAK_LIFT)
    for r in weak.collect():
        log.warning("rule %s has a lift of %.2f: little better than chance", r["rule"], r["lift"])
    return {"individual": single.orderBy(F.desc("lift")), "combined": combined_rules(flagged, settings, rules), "at_k": precision_at_k(flagged, settings=settings), "weak": weak}
