"""Node features over the days before a transfer, and the history of a pair."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, MODEL_METRICS, Settings
from ..functions.columns import clipped, micros, ratio, require_columns
from ..scratch import materialize
from .enrich import require_unique
from .windows import prior, prior_count, prior_mean

DAY_US = 86_400_000_000
METRICS = (
    "in_degree", "txn_count_in", "amt_in_sum", "amt_in_max", "unique_currencies_in", "unique_formats_in", "out_degree",
    "txn_count_out", "amt_out_sum", "fan_ratio", "flow_through", "amt_concentration", "reciprocity",
)
ZERO_FILLED = ("in_degree", "out_degree", "txn_count_in", "txn_count_out")


def with_day(df: DataFrame) -> DataFrame:
    """Whole 24-hour periods since the first row, not calendar days."""
    start = df.agg(F.min(micros("timestamp")).alias("__start"))
    return df.crossJoin(F.broadcast(start)).withColumn("day", F.floor((micros("timestamp") - F.col("__start")) / DAY_US).cast("int")).drop("__start")


def node_table(df: DataFrame, widths: tuple[int, ...] = DEFAULT.widths) -> DataFrame:
    """(node, day, metric_Wd ...) of every account and day that the ledger has, over [day - W, day).

    Transfers are first summed by pair and day. Each such row then meets the days it counts for,
    once for all widths: a width only takes part with rows young enough. Both directions of a pair
    meet in one row, so degrees are counts of pairs, and reciprocity needs no lookup. A width
    without any activity has NULL in all its metrics.
    """
    require_columns(df, ("src_account", "dst_account", "day", "amount_paid", "currency_paid", "payment_format"))
    most = max(widths)
    days = df.select(F.col("day").alias("D")).distinct()
    hop = F.explode(F.sequence(F.col("day") + 1, F.col("day") + most)).alias("D")
    age = F.col("D") - F.col("day")

    daily = df.groupBy("src_account", "dst_account", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_paid").alias("s"), F.max("amount_paid").alias("m"))
    a, b = F.least("src_account", "dst_account"), F.greatest("src_account", "dst_account")
    hops = daily.select(a.alias("a"), b.alias("b"), (F.col("src_account") == a).alias("fwd"), "day", "n", "s", "m", hop).join(days, "D", "left_semi")
    both = []
    for w in widths:
        for way, here in (("f", F.col("fwd")), ("r", ~F.col("fwd"))):
            young = here & (age <= w)
            both += [F.coalesce(f(F.when(young, F.col(c))), F.lit(0)).alias(f"{way}{c}{w}") for c, f in (("n", F.sum), ("s", F.sum), ("m", F.max))]
    pairs = hops.groupBy("a", "b", "D").agg(*both)

    def end(node: str, out: str, into: str):
        cells = [F.col(node).alias("node")]
        for w in widths:
            cells += [F.col(f"{out}{c}{w}").alias(f"o{c}{w}") for c in "nsm"] + [F.col(f"{into}{c}{w}").alias(f"i{c}{w}") for c in "nsm"]
        return F.struct(*cells)

    ends = F.when(F.col("a") == F.col("b"), F.array(end("a", "f", "f"))).otherwise(F.array(end("a", "f", "r"), end("b", "r", "f")))
    rows = pairs.select("D", F.explode(ends).alias("e")).select("D", "e.*")
    sums = []
    for w in widths:
        into, out = F.col(f"in{w}"), F.col(f"on{w}")
        one = lambda c: F.sum(c.cast("long"))
        sums += [
            one(into > 0).alias(f"in_degree_{w}d"), F.sum(into).alias(f"txn_count_in_{w}d"), F.sum(f"is{w}").alias(f"amt_in_sum_{w}d"), F.max(f"im{w}").alias(f"amt_in_max_{w}d"),
            one(out > 0).alias(f"out_degree_{w}d"), F.sum(out).alias(f"txn_count_out_{w}d"), F.sum(f"os{w}").alias(f"amt_out_sum_{w}d"),
            one((into > 0) & (out > 0)).alias(f"__mutual_{w}"), one((into > 0) | (out > 0)).alias(f"__partners_{w}"),
        ]
    nodes = rows.groupBy("node", "D").agg(*sums)

    kinds = df.groupBy(F.col("dst_account").alias("node"), "day").agg(F.collect_set("currency_paid").alias("c"), F.collect_set("payment_format").alias("p"))
    kinds = kinds.select("node", "day", "c", "p", hop).join(days, "D", "left_semi")
    sizes = [F.size(F.array_distinct(F.flatten(F.collect_list(F.when(age <= w, F.col(c)))))).cast("long").alias(f"{name}_{w}d") for w in widths for c, name in (("c", "unique_currencies_in"), ("p", "unique_formats_in"))]
    nodes = nodes.join(kinds.groupBy("node", "D").agg(*sizes), ["node", "D"], "left")

    out = [F.col("node"), F.col("D").alias("day")]
    for w in widths:
        c = lambda name, w=w: F.col(f"{name}_{w}d")
        derived = {
            "fan_ratio": c("in_degree") / (c("out_degree") + 1),
            "flow_through": F.when(c("amt_in_sum") > 0, c("amt_out_sum") / (c("amt_in_sum") + 1)),
            "amt_concentration": F.when(c("amt_in_sum") > 0, c("amt_in_max") / c("amt_in_sum")),
            "reciprocity": clipped(ratio(F.col(f"__mutual_{w}"), F.col(f"__partners_{w}"))),
            "unique_currencies_in": F.coalesce(c("unique_currencies_in"), F.lit(0)),
            "unique_formats_in": F.coalesce(c("unique_formats_in"), F.lit(0)),
        }
        present = F.col(f"__partners_{w}") > 0
        out += [F.when(present, derived.get(m, c(m))).alias(f"{m}_{w}d") for m in METRICS]
    return nodes.select(*out)


def pair_features(df: DataFrame, settings: Settings = DEFAULT, hot_pairs: bool = False) -> DataFrame:
    """Prior transfers of a pair, whether this is its first, and the log distance from its own
    geometric mean. ``hot_pairs``: no task may hold all rows of a pair; they are cut by day, and each
    day starts from what the days before it sum up to."""
    pair, log_amount = ["src_account", "dst_account"], F.log1p("amount_paid")
    if hot_pairs:
        df = df.withColumn("__chunk", F.date_trunc("day", "timestamp"))
        before = Window.partitionBy(*pair).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        sums = df.groupBy(*pair, "__chunk").agg(F.count(F.lit(1)).alias("__n"), F.count(log_amount).alias("__a"), F.coalesce(F.sum(log_amount), F.lit(0.0)).alias("__s"))
        starts = sums.select(*pair, "__chunk", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("__n", "__a", "__s")])
        within = prior(*pair, "__chunk")
        known = F.col("__a0") + F.count(log_amount).over(within)
        mean = (F.col("__s0") + F.coalesce(F.sum(log_amount).over(within), F.lit(0.0))) / F.nullif(known, F.lit(0).cast("long"))
        df = df.join(starts, [*pair, "__chunk"]).withColumns({"pair_txn_count_prior": F.col("__n0") + prior_count(*pair, "__chunk"), "__mean": mean})
        df = df.drop("__chunk", "__n0", "__a0", "__s0")
    else:
        df = df.withColumns({"pair_txn_count_prior": prior_count(*pair), "__mean": prior_mean(log_amount, *pair)})
    deviation = F.when(F.col("pair_txn_count_prior") >= settings.min_pair_prior, log_amount - F.col("__mean"))
    return df.withColumns({"is_first_interaction": F.col("pair_txn_count_prior") == 0, "pair_amt_log_dev": deviation}).drop("__mean")


def join_side(df: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
    """A node table's metrics for one side of each transfer; (node, day) is its key."""
    own = nodes.select(F.col("node").alias(f"{side}_account"), "day", *[F.col(c).alias(f"{side}_{c}") for c in nodes.columns if c not in ("node", "day")])
    return df.join(own, [f"{side}_account", "day"], "left")


#: What ``pair_features`` adds to a transfer.
PAIR_COLUMNS = ("pair_txn_count_prior", "is_first_interaction", "pair_amt_log_dev")


def model_inputs(columns: Iterable[str]) -> list[str]:
    """Those of a table's columns that are graph features for models, in the table's order: what
    ``join_side`` and ``accelerations`` made of a model metric, and the pair's history."""
    own = re.compile(rf"(?:src|dst)_(?:{'|'.join(MODEL_METRICS)})_(?:\d+d|accel)")
    return [c for c in columns if c in PAIR_COLUMNS or own.fullmatch(c)]


def accelerations(df: DataFrame, short: int = 1, long: int = 7) -> DataFrame:
    """Degree over the short window by that over the long one, after counts are zero-filled."""
    return df.withColumns({f"{s}_{m}_accel": ratio(F.col(f"{s}_{m}_{short}d"), F.col(f"{s}_{m}_{long}d")) for s in ("src", "dst") for m in ("in_degree", "out_degree")})


def build_graph_features(df: DataFrame, settings: Settings = DEFAULT, hot_pairs: bool = False, validate: bool = False) -> DataFrame:
    """Two joins bring all widths to both sides; counts without activity are 0, the rest NULL. By its
    last grouping (node, day) is the node table's key; ``validate`` writes the table out and counts."""
    dated = with_day(pair_features(df, settings, hot_pairs))
    nodes = node_table(with_day(df), settings.widths)
    if validate:
        nodes = require_unique(materialize(nodes), "node", "day")
    out = join_side(join_side(dated, nodes, "src"), nodes, "dst")
    out = out.fillna(0, subset=[f"{s}_{m}_{w}d" for s in ("src", "dst") for m in ZERO_FILLED for w in settings.widths])
    if 1 in settings.widths and 7 in settings.widths:
        out = accelerations(out)
    return out.drop("day")


def as_float32(df: DataFrame) -> DataFrame:
    """For the sink: all doubles in half the space."""
    return df.withColumns({c: F.col(c).cast("float") for c, t in df.dtypes if t == "double"})
