"""Quality of a ranking: curves over distinct scores, thresholds, segments, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import ratio
from ..scratch import materialize
from .rules import effects, label_totals, ranking, top_k
from .windows import prefix_sums, quantile_bucket


def score_counts(df: DataFrame, score: str = "score", settings: Settings = DEFAULT) -> DataFrame:
    """A table of each distinct score, the rows (n) and positives (p) that have it; what is said of a
    ranking below needs no more of its rows."""
    known = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score"))
    return materialize(known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(settings.target).cast("long")).alias("p")))


def score_steps(counts: DataFrame) -> DataFrame:
    """``score_counts`` with the rows and positives at a score or above (alerts, tp), and all of them
    (total_n, total_p)."""
    totals = counts.agg(F.sum("n").alias("total_n"), F.sum("p").alias("total_p"))
    upto = prefix_sums(counts, [], "score", {"n": "__n", "p": "__p"}).crossJoin(F.broadcast(totals))
    above = {"alerts": F.col("total_n") - F.col("__n") + F.col("n"), "tp": F.col("total_p") - F.col("__p") + F.col("p")}
    return upto.withColumns(above).drop("__n", "__p")


def _ap() -> Column:
    return F.sum(ratio(F.col("p"), F.col("total_p")) * F.col("tp") / F.col("alerts")).alias("pr_auc")


def _auc() -> Column:
    negatives, above = F.col("n") - F.col("p"), F.col("tp") - F.col("p")
    wins = F.sum(negatives.cast("double") * (above + F.col("p") / 2))
    pairs = F.max(F.col("total_p").cast("double") * (F.col("total_n") - F.col("total_p")))
    return ratio(wins, pairs).alias("roc_auc")


def ap_of(steps: DataFrame) -> DataFrame:
    return steps.agg(_ap())


def average_precision(df: DataFrame, score: str = "score", settings: Settings = DEFAULT) -> DataFrame:
    """pr_auc: the sum over scores of recall gained times precision there (no interpolation)."""
    return ap_of(score_steps(score_counts(df, score, settings)))


def roc_auc(df: DataFrame, score: str = "score", settings: Settings = DEFAULT) -> DataFrame:
    """roc_auc: how often a positive outranks a negative, ties by half."""
    return score_steps(score_counts(df, score, settings)).agg(_auc())


def curve_of(steps: DataFrame) -> DataFrame:
    return steps.select(F.col("score").alias("threshold"), "alerts", ratio(F.col("tp"), F.col("alerts")).alias("precision"), ratio(F.col("tp"), F.col("total_p")).alias("recall"))


def pr_curve(df: DataFrame, score: str = "score", settings: Settings = DEFAULT) -> DataFrame:
    return curve_of(score_steps(score_counts(df, score, settings)))


def threshold_of(steps: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The highest threshold that reaches the target recall; if none does, one of the most recall."""
    viable = F.col("recall") >= settings.target_recall
    rank = F.struct(F.coalesce(viable, F.lit(False)).alias("v"), F.when(viable, F.col("threshold")).otherwise(F.col("recall")).alias("r"), (-F.col("threshold")).alias("t"))
    best = curve_of(steps).agg(F.max_by(F.struct("threshold", "precision", "recall"), rank).alias("b"))
    return best.select(F.col("b.threshold").alias("threshold"), F.col("b.precision").alias("val_precision"), F.col("b.recall").alias("val_recall"), F.lit(settings.target_recall).alias("target_recall"))


def choose_threshold(df: DataFrame, score: str = "score", settings: Settings = DEFAULT) -> DataFrame:
    return threshold_of(score_steps(score_counts(df, score, settings)), settings)


def blind_segments(segments: DataFrame, positives: int = 20, recall: float = 0.2) -> DataFrame:
    """Of ``segment_recall``, the segments with many positives of which hardly any is caught."""
    return segments.filter((F.col("positives") >= positives) & (F.col("recall") < recall))


def operating_point(df: DataFrame, threshold: float, score: str = "score", settings: Settings = DEFAULT) -> DataFrame:
    y, hit = F.col(settings.target) == 1, F.col(score) >= threshold
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    one = df.agg(F.count(F.lit(1)).alias("n"), count(hit).alias("alerts"), count(hit & y).alias("true_positives"), count(hit & ~y).alias("false_positives"), count(~hit & y).alias("false_negatives"))
    tp = F.col("true_positives")
    return one.select(
        F.lit(float(threshold)).alias("threshold"), "alerts", ratio(F.col("alerts"), F.col("n")).alias("alert_rate"), "true_positives", "false_positives", "false_negatives",
        ratio(tp, F.col("alerts")).alias("precision"), ratio(tp, tp + F.col("false_negatives")).alias("recall"), ratio(F.col("alerts"), tp).alias("alerts_per_catch"),
    )


def recall_at_k(df: DataFrame, score: str = "score", ks=None, settings: Settings = DEFAULT) -> DataFrame:
    own = ranking(df, score, settings=settings)
    found = top_k(own, score, ks or settings.k_values, settings)
    out = effects(F.col("n"), F.col("k"), F.col("caught"), F.col("pos"))
    return found.crossJoin(F.broadcast(label_totals(own, settings))).select("k", "caught", *[c.alias(k) for k, c in out.items()])


def segment_recall(df: DataFrame, column: str, threshold: float, score: str = "score", settings: Settings = DEFAULT) -> DataFrame:
    """segment, rows, positives, caught, alerts, recall, precision; rows without a segment don't count."""
    y, hit = F.col(settings.target) == 1, F.col(score) >= threshold
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    found = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("segment")).agg(F.count(F.lit(1)).alias("rows"), count(y).alias("positives"), count(hit & y).alias("caught"), count(hit).alias("alerts"))
    return found.withColumns({"recall": ratio(F.col("caught"), F.col("positives")), "precision": ratio(F.col("caught"), F.col("alerts"))})


def calibration(df: DataFrame, score: str = "score", bins: int = 10, settings: Settings = DEFAULT) -> DataFrame:
    counts = score_counts(df, score, settings)
    by = counts.withColumn("bin", quantile_bucket(counts, "score", "n", bins)).groupBy("bin")
    found = by.agg(F.sum("n").alias("n"), (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean_predicted"), (F.sum("p") / F.sum("n")).alias("observed_rate"))
    return found.withColumn("gap", F.col("mean_predicted") - F.col("observed_rate"))


def brier(df: DataFrame, score: str = "score", settings: Settings = DEFAULT) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - F.col(settings.target), F.lit(2.0))).alias("brier"))


def headline(df: DataFrame, baseline: float, score: str = "score", settings: Settings = DEFAULT) -> DataFrame:
    """pr_auc, roc_auc, base_rate, and pr_auc as a multiple of a baseline's and of chance; rows
    without a score count for the base rate alone."""
    own = ranking(df, score, settings=settings)
    both = score_steps(score_counts(own, score, settings)).agg(_ap(), _auc()).crossJoin(own.agg(F.avg(F.col(settings.target).cast("double")).alias("base_rate")))
    return both.withColumns({"vs_baseline": F.col("pr_auc") / F.lit(baseline), "vs_random": ratio(F.col("pr_auc"), F.col("base_rate"))})


def model_vs_rules(df: DataFrame, score: str = "score", rule_score: str = "rule_score", settings: Settings = DEFAULT) -> DataFrame:
    own = ranking(df, score, rule_score, settings=settings)
    model = top_k(own, score, settings.k_values, settings).withColumnRenamed("caught", "model_caught")
    rules = top_k(own, rule_score, settings.k_values, settings).withColumnRenamed("caught", "rules_caught")
    m, r, k = F.col("model_caught"), F.col("rules_caught"), F.col("k")
    return model.join(F.broadcast(rules), "k").withColumns({"model_precision": ratio(m, k), "rules_precision": ratio(r, k), "improvement": ratio(m, r)})
