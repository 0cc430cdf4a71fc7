"""Streaming twins of the batch features, for a ledger that keeps growing."""

from __future__ import annotations

from collections.abc import Iterator
from math import log1p

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER = {"src": "dst", "dst": "src"}


def hopping_counts(stream: DataFrame, width_days: int, side: str = "dst", late: str = "1 day", origin: str = "0 seconds") -> DataFrame:
    """Transfers, amounts and exact partners of an account over the ``width_days`` days before each
    day: what the node table says of (account, day), where ``day`` is a window's end. Days are 24
    hours each, counted from the epoch moved by ``origin`` (a duration below a day, such as where
    the ledger's first row lies in its day). Windows that the watermark has passed are final."""
    window = F.window("timestamp", f"{width_days} days", "1 day", origin)
    return (
        stream.withWatermark("timestamp", late).groupBy(window, F.col(f"{side}_account").alias("account"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount_paid").alias("amount"), F.max("amount_paid").alias("largest"), F.size(F.collect_set(f"{OTHER[side]}_account")).cast("long").alias("partners"))
        .select("account", F.col("window.start").alias("start"), F.col("window.end").alias("day"), "n", "amount", "largest", "partners")
    )


_STATE = "n long, last_us long, log_sum double, partners array<long>"


def prior_features(stream: DataFrame, side: str = "src", late: str = "1 day", forget: str | None = None) -> DataFrame:
    """What the batch history says of each transfer on one side, from state kept by account: count,
    last moment, partners and the sum of log amounts. Rows within a batch are taken in order of
    time; partners are kept as 64-bit hashes.

    State grows with accounts and their partners. ``forget``, a duration such as "90 days", drops
    that of accounts without a transfer for so long, as seen by the watermark; one that comes back
    starts anew, which the batch history doesn't."""
    other = OTHER[side]
    out = f"{side}_account string, txn_id long, {side}_txn_count_prior long, {side}_secs_since_last double, {side}_unique_{other}_prior long, {side}_log_mean_prior double"
    names = [c.split()[0] for c in out.split(", ")]
    idle = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last, total, partners = state.get if state.exists else (0, None, 0.0, [])
        known = set(partners)
        rows = pd.concat(frames).sort_values(["us", "txn_id"], kind="stable")
        made = []
        for row_id, us, partner, amount in zip(rows["txn_id"], rows["us"], rows["partner"], rows["amount_paid"], strict=True):
            gap = None if last is None else (us - last) / 1e6
            made.append((key[0], row_id, n, gap, len(known), total / n if n else None))
            n, last, total = n + 1, int(us), total + log1p(amount)
            known.add(int(partner))
        state.update((n, last, total, sorted(known)))
        if idle is not None:
            state.setTimeoutTimestamp(max(last // 1000 + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(made, columns=names)

    rows = stream.withWatermark("timestamp", late).select(f"{side}_account", "timestamp", "txn_id", "amount_paid", F.unix_micros("timestamp").alias("us"), F.xxhash64(f"{other}_account").alias("partner"))
    return rows.groupBy(f"{side}_account").applyInPandasWithState(update, out, _STATE, "append", "NoTimeout" if idle is None else "EventTimeTimeout")
