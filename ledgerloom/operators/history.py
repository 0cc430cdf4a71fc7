"""What an account had done before each transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, FEATURE_COLUMNS, Settings
from ..functions.columns import flag, hour_angle, known, micros, require_columns
from .windows import first_of, ordered, prior_count, prior_gap, prior_mean, running_distinct, with_pct_rank

#: The mean log amount of a sender's earlier transfers, on its way from the account windows.
LOG_MEAN = "__src_log_mean_prior"
REQUIRED = ("txn_id", "timestamp", "src_account", "dst_account", "amount_paid")


def _after(df: DataFrame, settings: Settings) -> DataFrame:
    guarded = lambda top, count: F.when(F.col(count) >= settings.min_prior, F.col(top) / F.col(count))
    return df.withColumns(
        {
            "src_secs_since_last_log": F.log1p("src_secs_since_last"),
            "src_fanout_ratio": guarded("src_unique_dst_prior", "src_txn_count_prior"),
            "dst_fanin_ratio": guarded("dst_unique_src_prior", "dst_txn_count_prior"),
        }
    )


def account_features(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return _accounts(df, settings).drop(LOG_MEAN)


def account_features_chunked(df: DataFrame, settings: Settings = DEFAULT, chunk: str = "day") -> DataFrame:
    return _accounts_chunked(df, settings, chunk).drop(LOG_MEAN)


def _accounts(df: DataFrame, settings: Settings) -> DataFrame:
    """Prior counts, gaps, running distinct counterparties and their ratios, for both sides.

    One exchange for each side: rows dealt by the sender serve the sender's windows and those of
    the pair, whose rows lie together then too."""
    require_columns(df, REQUIRED)
    by_src = df.repartition("src_account").withColumn("__first", first_of("src_account", "dst_account"))
    by_src = by_src.withColumns(  # these share one sort
        {
            "src_txn_count_prior": prior_count("src_account"), "src_secs_since_last": prior_gap("src_account"),
            "src_unique_dst_prior": running_distinct("__first", "src_account"), LOG_MEAN: prior_mean(F.log1p("amount_paid"), "src_account"),
        }
    )
    by_dst = by_src.repartition("dst_account").withColumns(
        {"dst_txn_count_prior": prior_count("dst_account"), "dst_secs_since_last": prior_gap("dst_account"), "dst_unique_src_prior": running_distinct("__first", "dst_account")}
    )
    return _after(by_dst.drop("__first"), settings)


def _accounts_chunked(df: DataFrame, settings: Settings, chunk: str = "day") -> DataFrame:
    """The same, for ledgers in which one account may hold a large share of all rows.

    An account's rows are cut by time; windows run within a chunk, and each chunk starts from
    what the chunks before it sum up to, so no task sorts a whole account."""
    require_columns(df, REQUIRED)
    place = F.struct("timestamp", "txn_id")
    firsts = df.groupBy("src_account", "dst_account").agg(F.min(place).alias("__place")).select("src_account", "dst_account", F.col("__place.txn_id").alias("__first_id"))
    out = df.join(firsts, ["src_account", "dst_account"]).withColumns({"__first": F.col("txn_id") == F.col("__first_id"), "__chunk": F.date_trunc(chunk, "timestamp")}).drop("__first_id")
    for side, other in (("src", "dst"), ("dst", "src")):
        keys = [f"{side}_account", "__chunk"]
        before = Window.partitionBy(keys[0]).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        logs = F.log1p("amount_paid")
        sums = out.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("__n"), F.sum(F.col("__first").cast("long")).alias("__d"), F.max(micros("timestamp")).alias("__last"), F.count(logs).alias("__a"), F.coalesce(F.sum(logs), F.lit(0.0)).alias("__s")
        )
        starts = sums.select(*keys, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("__n", "__d", "__a", "__s")], F.max("__last").over(before).alias("__last0"))
        within = ordered(*keys)
        upto = within.rowsBetween(Window.unboundedPreceding, -1)
        gap = (micros("timestamp") - F.coalesce(F.lag(micros("timestamp")).over(within), F.col("__last0"))) / F.lit(1e6)
        seen = F.coalesce(F.sum(F.col("__first").cast("long")).over(upto), F.lit(0))
        new = {f"{side}_txn_count_prior": F.col("__n0") + F.row_number().over(within) - 1, f"{side}_secs_since_last": gap, f"{side}_unique_{other}_prior": F.col("__d0") + seen}
        if side == "src":
            amounts = F.col("__a0") + F.count(logs).over(upto)
            new[LOG_MEAN] = (F.col("__s0") + F.coalesce(F.sum(logs).over(upto), F.lit(0.0))) / F.nullif(amounts, F.lit(0).cast("long"))
        out = out.join(starts, keys).withColumns(new).drop("__n0", "__d0", "__a0", "__s0", "__last0")
    return _after(out.drop("__first", "__chunk"), settings)


def amount_features(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Percentile of the amount within its currency, and its log distance from the sender's own
    geometric mean. The percentile ranks over the whole table, as it is defined."""
    require_columns(df, ("amount_paid", "currency_paid", "src_txn_count_prior"))
    log_amount = F.log1p("amount_paid")
    mean = F.col(LOG_MEAN) if LOG_MEAN in df.columns else prior_mean(log_amount, "src_account")
    df = df.withColumn("src_log_dev", F.when(F.col("src_txn_count_prior") >= settings.min_prior, log_amount - mean)).drop(LOG_MEAN)
    return with_pct_rank(df, "amount_paid", "currency_paid", "amt_pct_ccy")


def fit_pct_rank(train: DataFrame, df: DataFrame, value: str = "amount_paid", by: str = "currency_paid", out: str = "amt_pct_ccy", steps: int = 1000) -> DataFrame:
    """The percentile learned from ``train`` alone: the share of its amounts not above a row's,
    read off ``steps`` quantiles of each currency. No row of ``df`` tells on another."""
    edges = train.filter(F.col(value).isNotNull()).groupBy(by).agg(F.percentile_approx(value, F.array(*[F.lit(i / steps) for i in range(1, steps + 1)]), F.lit(10 * steps)).alias("__edges"))
    share = F.size(F.filter("__edges", lambda e: e <= F.col(value))) / F.lit(float(steps))
    return df.join(edges, by, "left").withColumn(out, F.when(F.col("__edges").isNotNull() & F.col(value).isNotNull(), share)).drop("__edges")


def time_features(df: DataFrame) -> DataFrame:
    hour = F.hour(F.col("timestamp").cast("timestamp"))
    return df.withColumns({"hour": hour, "hour_sin": F.sin(hour_angle(hour)), "hour_cos": F.cos(hour_angle(hour)), "is_hour_zero": hour == 0})


def threshold_flags(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return df.withColumns(
        {
            "src_rapid_txn": flag(known(F.col("src_secs_since_last")) <= settings.rapid_seconds),
            "src_dormant_wake": flag(known(F.col("src_secs_since_last")) > settings.dormant_seconds),
            "dst_high_fanin": flag(known(F.col("dst_fanin_ratio")) > settings.fanin_ratio),
        }
    )


def build_features(df: DataFrame, settings: Settings = DEFAULT, hot_accounts: bool = False) -> DataFrame:
    """All history features of a ledger. ``hot_accounts``: no task may hold a whole account's rows."""
    accounts = _accounts_chunked if hot_accounts else _accounts
    return threshold_flags(time_features(amount_features(accounts(df, settings), settings)), settings)


def feature_matrix(df: DataFrame) -> DataFrame:
    return require_columns(df, FEATURE_COLUMNS).select(*FEATURE_COLUMNS)
