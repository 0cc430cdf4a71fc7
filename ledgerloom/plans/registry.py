"""Every registered query: an operator applied to the ledger view of the given tables.

Results keep to what both engines can be compared by: counts are longs, doubles are rounded to six
places, moments are epoch microseconds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..config import MODEL_METRICS
from ..functions.columns import micros, number_after
from ..ml import experiments, models
from ..operators import clean, enrich, graph, history, metrics, profile, rules, split, stats
from ..sources import files, runs
from ..sources.views import VIEW_SETTINGS as S
from ..sources.views import ledger, table, transfers
from ..streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return run


def plain(df: DataFrame) -> DataFrame:
    out = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        out.append((F.round(x, 6) + F.lit(0.0) if t in ("double", "float") else x.cast("long") if t in ("int", "tinyint", "smallint") else x).alias(c))
    return df.select(*out)


# -- the tables the queries start from ------------------------------------------


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw columns, with moments cut to the minute, so that many tie."""
    src, dst = F.col("src_account").cast("long"), F.col("dst_account").cast("long")
    region = lambda a: F.concat(F.lit("R"), F.pmod(a, F.lit(5)).cast("string"))
    return transfers(spark, sf_dir).select(
        F.date_format("timestamp", clean.TIMESTAMP_FORMAT).alias("timestamp"), F.pmod(src, F.lit(10)).alias("src_bank"), "src_account", F.pmod(dst, F.lit(10)).alias("dst_bank"), "dst_account",
        (F.col("amount_paid") * F.lit(0.5)).alias("amount_received"), region(dst).alias("currency_received"), "amount_paid", region(src).alias("currency_paid"), "payment_format", "is_laundering", "txn_id",
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(raw_ledger(spark, sf_dir), S)


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").filter("c_acctbal > 0").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = joined.select(
        F.col("n_name").alias("Bank Name"), F.pmod("c_custkey", F.lit(10)).alias("Bank ID"), F.col("c_custkey").cast("string").alias("Account Number"),
        F.col("c_name").alias("Entity ID"), F.concat("c_mktsegment", F.lit(" #"), F.col("c_custkey").cast("string")).alias("Entity Name"),
    )
    return enrich.clean_accounts(raw, S)


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.merge_accounts(cleaned(spark, sf_dir), dimension(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.build_features(ledger(spark, sf_dir), S)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).withColumn("score", F.round("amt_pct_ccy", 6))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(scored(spark, sf_dir), S)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_table(graph.with_day(ledger(spark, sf_dir)), S.widths)


# -- cleaning and enrichment ------------------------------------------------------


@query
def clean_ledger(spark, sf_dir):
    return cleaned(spark, sf_dir).select(
        "txn_id", micros("timestamp").alias("us"), "src_account", "dst_account", "amount_paid", "amount_received", "amount_delta", "currency_paid", "currency_received",
        "payment_format", "is_laundering", "is_self_loop", "is_cross_currency", "is_burn_in",
    )


@query
def dataset_summary(spark, sf_dir):
    return clean.summarise(ledger(spark, sf_dir))


@query
def clean_accounts(spark, sf_dir):
    return dimension(spark, sf_dir)


@query
def merge_accounts(spark, sf_dir):
    return merged(spark, sf_dir).select("txn_id", *[f"{s}_{a}" for s in ("src", "dst") for a in enrich.ATTRIBUTES])


@query
def merge_summary(spark, sf_dir):
    return enrich.summarise_merge(merged(spark, sf_dir))


@query
def duplicate_keys(spark, sf_dir):
    return enrich.duplicate_keys(table(spark, sf_dir, "lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("account_key")))


# -- history -------------------------------------------------------------------------


def _account(spark, sf_dir, *columns):
    return history.account_features(ledger(spark, sf_dir), S).select("txn_id", *columns)


@query
def prior_counts(spark, sf_dir):
    return _account(spark, sf_dir, "src_txn_count_prior", "dst_txn_count_prior")


@query
def prior_gaps(spark, sf_dir):
    return _account(spark, sf_dir, "src_secs_since_last", "dst_secs_since_last", "src_secs_since_last_log")


@query
def running_distinct(spark, sf_dir):
    return _account(spark, sf_dir, "src_unique_dst_prior", "dst_unique_src_prior")


@query
def running_distinct_chunked(spark, sf_dir):
    out = history.account_features_chunked(ledger(spark, sf_dir), S)
    return out.select("txn_id", "src_txn_count_prior", "dst_txn_count_prior", "src_secs_since_last", "dst_secs_since_last", "src_unique_dst_prior", "dst_unique_src_prior")


@query
def fan_ratios(spark, sf_dir):
    return _account(spark, sf_dir, "src_fanout_ratio", "dst_fanin_ratio")


@query
def amount_pct_rank(spark, sf_dir):
    return features(spark, sf_dir).select("txn_id", "amt_pct_ccy")


@query
def log_deviation(spark, sf_dir):
    return features(spark, sf_dir).select("txn_id", "src_log_dev")


@query
def time_features(spark, sf_dir):
    return history.time_features(ledger(spark, sf_dir)).select("txn_id", "hour", "hour_sin", "hour_cos", "is_hour_zero")


@query
def threshold_flags(spark, sf_dir):
    return features(spark, sf_dir).select("txn_id", "src_rapid_txn", "src_dormant_wake", "dst_high_fanin")


@query
def account_features_full(spark, sf_dir):
    return features(spark, sf_dir).select(
        "txn_id", "src_txn_count_prior", "dst_txn_count_prior", "src_secs_since_last", "dst_secs_since_last", "src_secs_since_last_log", "src_unique_dst_prior", "dst_unique_src_prior",
        "src_fanout_ratio", "dst_fanin_ratio", "amt_pct_ccy", "src_log_dev", "hour", "hour_sin", "hour_cos", "is_hour_zero", "src_rapid_txn", "src_dormant_wake", "dst_high_fanin",
    )


@query
def rejected_history(spark, sf_dir):
    return profile.rejected_history(ledger(spark, sf_dir)).select("txn_id", "src_amt_mean_prior", "src_amt_vs_own", "src_log_ratio", "src_is_new")


@query
def first_rows(spark, sf_dir):
    return profile.first_rows(ledger(spark, sf_dir)).select("src_account", "txn_id")


# -- graph -----------------------------------------------------------------------------


def _nodes(width):
    def run(spark, sf_dir):
        made = nodes(spark, sf_dir)
        names = [f"{m}_{width}d" for m in graph.METRICS]
        return made.filter(F.col(names[0]).isNotNull()).select("node", "day", *[F.col(n).alias(m) for n, m in zip(names, graph.METRICS, strict=True)])

    run.__name__ = f"graph_nodes_{width}d"
    return run


for _width in S.widths:
    query(_nodes(_width))


@query
def reciprocity_7d(spark, sf_dir):
    return nodes(spark, sf_dir).filter("reciprocity_7d is not null").select("node", "day", "reciprocity_7d")


@query
def pair_features(spark, sf_dir):
    return graph.pair_features(ledger(spark, sf_dir), S).select("txn_id", "pair_txn_count_prior", "is_first_interaction", "pair_amt_log_dev")


@query
def graph_join_sides(spark, sf_dir):
    out = graph.build_graph_features(ledger(spark, sf_dir), S)
    return out.select("txn_id", *[f"{s}_{m}_{w}d" for s in ("src", "dst") for m in (*MODEL_METRICS, "txn_count_in", "txn_count_out") for w in S.widths])


@query
def degree_accel(spark, sf_dir):
    out = graph.build_graph_features(ledger(spark, sf_dir), S)
    return out.select("txn_id", *[f"{s}_{m}_accel" for s in ("src", "dst") for m in ("in_degree", "out_degree")])


# -- splits ------------------------------------------------------------------------------


@query
def split_boundaries(spark, sf_dir):
    train, val = split.boundaries(ledger(spark, sf_dir), S)
    return spark.createDataFrame([(train, val)], "train_us long, val_us long")


@query
def split_summary(spark, sf_dir):
    return split.split_summary(split.with_split(ledger(spark, sf_dir), S), S)


@query
def training_rows(spark, sf_dir):
    return split.build_splits(ledger(spark, sf_dir), S).select("txn_id", "split")


@query
def split_composition(spark, sf_dir):
    return profile.composition(split.with_split(ledger(spark, sf_dir), S), "payment_format", "error", S)


# -- rules ---------------------------------------------------------------------------------


@query
def rule_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("txn_id", *rules.RULES)


@query
def rule_scores(spark, sf_dir):
    return flagged(spark, sf_dir).select("txn_id", "rule_score", "any_rule")


@query
def rule_individual(spark, sf_dir):
    return rules.individual_rules(flagged(spark, sf_dir), S)


@query
def rule_combined(spark, sf_dir):
    return rules.combined_rules(flagged(spark, sf_dir), S)


@query
def rule_precision_at_k(spark, sf_dir):
    return rules.precision_at_k(flagged(spark, sf_dir), settings=S)


@query
def rule_weak(spark, sf_dir):
    return rules.individual_rules(flagged(spark, sf_dir), S).filter("lift < 1.2").select("rule", "lift")


@query
def rule_ablation(spark, sf_dir):
    left = rules.without("business_hours")
    return rules.combined_rules(rules.apply_rules(scored(spark, sf_dir), S, left), S, left)


# -- ranking metrics -------------------------------------------------------------------------


@query
def ap_score(spark, sf_dir):
    return metrics.average_precision(scored(spark, sf_dir), settings=S)


@query
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored(spark, sf_dir), settings=S)


@query
def pr_curve(spark, sf_dir):
    return metrics.pr_curve(scored(spark, sf_dir), settings=S)


@query
def threshold_at_recall(spark, sf_dir):
    return metrics.choose_threshold(scored(spark, sf_dir), settings=S)


@query
def operating_point(spark, sf_dir):
    return metrics.operating_point(scored(spark, sf_dir), 0.5, settings=S)


@query
def recall_at_k(spark, sf_dir):
    return metrics.recall_at_k(scored(spark, sf_dir), settings=S)


@query
def segment_recall(spark, sf_dir):
    return metrics.segment_recall(scored(spark, sf_dir), "payment_format", 0.5, settings=S)


@query
def calibration_deciles(spark, sf_dir):
    return metrics.calibration(scored(spark, sf_dir), settings=S)


@query
def brier(spark, sf_dir):
    return metrics.brier(scored(spark, sf_dir), settings=S)


@query
def headline_metrics(spark, sf_dir):
    return metrics.headline(scored(spark, sf_dir), 0.0126, settings=S)


@query
def model_vs_rules_at_k(spark, sf_dir):
    return metrics.model_vs_rules(flagged(spark, sf_dir), settings=S)


# -- exploration -------------------------------------------------------------------------------


@query
def cat_lift(spark, sf_dir):
    return profile.categorical_lift(ledger(spark, sf_dir), "payment_format", S)


@query
def cat_lift_having(spark, sf_dir):
    return profile.categorical_lift(ledger(spark, sf_dir), "dst_account", S, min_group=100)


@query
def bool_lift(spark, sf_dir):
    return profile.boolean_lift(ledger(spark, sf_dir), "is_cross_currency", S)


@query
def zero_positive(spark, sf_dir):
    return profile.zero_positive(profile.categorical_lift(ledger(spark, sf_dir), "src_account", S)).select("value", "n")


@query
def numeric_describe(spark, sf_dir):
    return profile.numeric_describe(ledger(spark, sf_dir), "amount_paid", S)


@query
def decile_rates(spark, sf_dir):
    return profile.decile_rates(ledger(spark, sf_dir), "amount_paid", S)


@query
def temporal_rollup(spark, sf_dir):
    return profile.temporal_rollup(ledger(spark, sf_dir), S)


@query
def daily_rollup(spark, sf_dir):
    return profile.daily_rollup(ledger(spark, sf_dir), S)


@query
def column_profile(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


@query
def target_balance(spark, sf_dir):
    return profile.target_balance(ledger(spark, sf_dir), S)


@query
def currency_stats(spark, sf_dir):
    return profile.group_stats(ledger(spark, sf_dir), "currency_paid", "amount_paid", "src_account")


@query
def threshold_sweep(spark, sf_dir):
    return profile.threshold_sweep(features(spark, sf_dir), "src_secs_since_last", (40_000, 80_000, 200_000, 300_000), settings=S)


@query
def value_counts(spark, sf_dir):
    return profile.value_counts(ledger(spark, sf_dir), "currency_received")


@query
def missingness(spark, sf_dir):
    return profile.missingness(features(spark, sf_dir), "src_log_dev", S)


@query
def conditional_rates(spark, sf_dir):
    parted = split.with_split(features(spark, sf_dir), S)
    return profile.conditional_rates(parted, {"dormant": F.col("src_dormant_wake"), "error": F.col("payment_format") == "error"}, "split", S)


@query
def log_histogram(spark, sf_dir):
    return profile.log_histogram(ledger(spark, sf_dir), "amount_paid", S)


@query
def logz_by_currency(spark, sf_dir):
    return profile.log_zscore(ledger(spark, sf_dir)).select("txn_id", "amt_logz_ccy")


@query
def crosstab_2x2(spark, sf_dir):
    return stats.crosstab(ledger(spark, sf_dir), "is_cross_currency", "is_laundering")


@query
def chi2_yates(spark, sf_dir):
    found = stats.two_by_two(ledger(spark, sf_dir), "is_cross_currency", "is_laundering")
    return spark.createDataFrame([(stats.chi2_yates(found)[0],)], "chi2 double")


@query
def fisher_exact(spark, sf_dir):
    found = stats.two_by_two(ledger(spark, sf_dir), "is_cross_currency", "is_laundering")
    return spark.createDataFrame([stats.fisher_exact(found)], "odds_ratio double, p_value double")


@query
def pearson_pairs(spark, sf_dir):
    return stats.pearson(features(spark, sf_dir), ("amount_paid", "amt_pct_ccy", "src_log_dev", "src_secs_since_last"))


@query
def spearman_pairs(spark, sf_dir):
    return stats.spearman(features(spark, sf_dir), ("amount_paid", "src_log_dev", "src_secs_since_last"))


@query
def strong_pairs(spark, sf_dir):
    return stats.strong_pairs(stats.pearson(features(spark, sf_dir), ("amount_paid", "amt_pct_ccy", "src_log_dev", "src_secs_since_last")), 0.05)


@query
def vif(spark, sf_dir):
    return stats.vif(features(spark, sf_dir), ("amount_paid", "amt_pct_ccy", "src_secs_since_last"))


@query
def plot_sample(spark, sf_dir):
    sampled = profile.sample_for_plots(ledger(spark, sf_dir), 500, S)
    return sampled.groupBy(F.col(S.target).cast("long").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query
def feature_projection(spark, sf_dir):
    kinds = merged(spark, sf_dir).select("txn_id", *[f"{s}_{a}" for s in ("src", "dst") for a in enrich.ATTRIBUTES])
    return history.feature_matrix(features(spark, sf_dir).join(kinds, "txn_id", "left"))


# -- guards ---------------------------------------------------------------------------------------


@query
def tail_summary(spark, sf_dir):
    return clean.tail_summary(clean.parse_timestamp(raw_ledger(spark, sf_dir)), S)


@query
def rows_after_merge(spark, sf_dir):
    before = cleaned(spark, sf_dir)
    after = enrich.require_same_rows(before, merged(spark, sf_dir), "merge")
    return before.agg(F.count(F.lit(1)).alias("before")).crossJoin(after.agg(F.count(F.lit(1)).alias("after")))


@query
def split_faults(spark, sf_dir):
    return split.split_faults(split.build_splits(ledger(spark, sf_dir), S), S, few=1000)


@query
def two_way_split(spark, sf_dir):
    return split.two_way(ledger(spark, sf_dir)).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.max(micros("timestamp")).alias("end_us"))


@query
def name_numbers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", number_after(F.col("c_name")).alias("number"))


@query
def blind_segments(spark, sf_dir):
    return metrics.blind_segments(metrics.segment_recall(scored(spark, sf_dir), "currency_paid", 0.9, settings=S)).select("segment", "positives", "recall")


# -- preparing models -------------------------------------------------------------------------------

_NUMBERS = ("src_secs_since_last_log", "src_log_dev", "dst_fanin_ratio", "src_fanout_ratio", "amt_pct_ccy")


@query
def prepared_medians(spark, sf_dir):
    return models.medians_of(features(spark, sf_dir), _NUMBERS)


@query
def prepared_categories(spark, sf_dir):
    return models.frequent_categories(ledger(spark, sf_dir), ("payment_format", "currency_paid", "dst_account"), 0.015)


@query
def prepared_rows(spark, sf_dir):
    made = features(spark, sf_dir)
    ready = models.Prepared.fit(made, _NUMBERS[:3], ("src_rapid_txn",), ("payment_format", "currency_paid", "dst_account"), 0.015).transform(made)
    return ready.select("txn_id", *[f"{p}_{c}" for c in _NUMBERS[:3] for p in "nm"], "b_src_rapid_txn", "c_payment_format", "c_currency_paid", "c_dst_account")


@query
def class_weights(spark, sf_dir):
    return models.with_weight(ledger(spark, sf_dir), S).groupBy(F.col(S.target).cast("long").alias("class")).agg(F.max("weight").alias("weight"))


@query
def fold_sizes(spark, sf_dir):
    folds = experiments.expanding_folds(ledger(spark, sf_dir), 3)
    sizes = [a.agg(F.lit(i).cast("long").alias("fold"), F.count(F.lit(1)).alias("train")).crossJoin(b.agg(F.count(F.lit(1)).alias("test"))) for i, (a, b) in enumerate(folds)]
    return reduce(DataFrame.union, sizes)


@query
def top_run(spark, sf_dir):
    """Runs as the suppliers give them: the balance is the metric, and a 7 in a name excludes."""
    made = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("run_id"), F.col("s_name").alias("name"), F.create_map(F.lit("pr_auc"), F.col("s_acctbal").cast("double")).alias("metrics"))
    return runs.top_run(made, exclude="7").select("run_id", "name", F.col("metrics")["pr_auc"].alias("pr_auc"))


# -- sinks and back -----------------------------------------------------------------------------------


@query
def csv_ledger(spark, sf_dir):
    """The raw ledger through CSV: written, scanned by position, cleaned."""
    path = scratch.new_path(spark)
    raw_ledger(spark, sf_dir).select(*clean.RAW_NAMES).write.csv(path, header=True)
    out = clean.clean(files.read_transactions(spark, path), S)
    return out.select(micros("timestamp").alias("us"), "src_account", "dst_account", "amount_paid", "currency_paid", "payment_format", "is_laundering", "is_self_loop", "is_burn_in")


@query
def split_sink(spark, sf_dir):
    path = files.write_splits(split.build_splits(ledger(spark, sf_dir), S), scratch.new_path(spark))
    return split.split_summary(files.read_split(spark, path, "val"), S).drop("rate")


@query
def stage_sink(spark, sf_dir):
    path = files.write_stage(ledger(spark, sf_dir).select("txn_id", "timestamp", "amount_paid"), scratch.new_path(spark), small=True, global_order=True)
    kept = files.read_stage(spark, path)
    return kept.select("txn_id", F.round(F.col("amount_paid").cast("double"), 1).alias("amount_paid"))


@query
def report_sink(spark, sf_dir):
    path = files.write_report(profile.categorical_lift(ledger(spark, sf_dir), "payment_format", S), scratch.new_path(spark))
    return files.read_report(spark, path).select("value", F.col("n").cast("long").alias("n"), "lift")


# -- streams ----------------------------------------------------------------------------------------


def _stream(spark, sf_dir):
    """The ledger as a stream of files."""
    given = ledger(spark, sf_dir).select("txn_id", "timestamp", "src_account", "dst_account", "amount_paid")
    path = scratch.new_path(spark)
    given.write.parquet(path)
    return spark.readStream.schema(given.schema).parquet(path)


def _streamed(spark, out, mode):
    """What a stream has given when all its files are read; the last batch holds all in complete mode."""
    path = scratch.new_path(spark)
    write = lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(path)
    run = out.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", scratch.new_path(spark)).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


@query
def stream_prior_src(spark, sf_dir):
    return _streamed(spark, incremental.prior_features(_stream(spark, sf_dir), "src"), "append").drop("src_account")


@query
def stream_prior_dst(spark, sf_dir):
    return _streamed(spark, incremental.prior_features(_stream(spark, sf_dir), "dst"), "append").drop("dst_account")


@query
def stream_windows(spark, sf_dir):
    found = _streamed(spark, incremental.hopping_counts(_stream(spark, sf_dir), 3), "complete")
    return found.select("account", micros("day").alias("day_us"), "n", "amount", "largest", "partners")


# -- models: no SQL says what they are, so they are only run --------------------------------------


@query
def logreg_scores(spark, sf_dir):
    train = scratch.materialize(features(spark, sf_dir))  # read by every step of a fit
    prepared, model = models.fit(models.default_specs()[0], train, settings=S)
    return models.score(model, prepared, train).select("txn_id", "score")
