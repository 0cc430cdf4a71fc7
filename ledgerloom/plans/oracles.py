"""The registered queries in DuckDB's SQL, formulated on their own where there is more than one way."""

R = "round({}, 6) + 0.0".format


def rounded(**columns: str) -> str:
    return ", ".join(f"{R(expression)} AS {name}" for name, expression in columns.items())


_TRANSFERS = """
transfers AS (
  SELECT event_id AS txn_id, ts AS timestamp, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS src_account,
         json_extract_string(props, '$.k') AS dst_account, value AS amount_paid, event_type AS payment_format,
         CAST((event_id * 7919 + user_id * 104729) % 97 < CASE WHEN event_type = 'error' THEN 12 ELSE 2 END AS BIGINT) AS y
  FROM events)"""
_LEDGER = f"""{_TRANSFERS},
rates AS (
  SELECT CAST(c_custkey AS VARCHAR) AS k, r_name AS currency
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ledger AS (
  SELECT t.*, a.currency AS currency_paid, b.currency AS currency_received, src_account = dst_account AS is_self_loop,
         a.currency <> b.currency AS is_cross_currency,
         t.timestamp < (SELECT date_trunc('day', min(timestamp)) + INTERVAL 2 DAY FROM transfers) AS is_burn_in
  FROM transfers t LEFT JOIN rates a ON a.k = src_account LEFT JOIN rates b ON b.k = dst_account)"""
_PRIOR = "PARTITION BY {} ORDER BY us, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_SRC, _DST, _PAIR = _PRIOR.format("src_account"), _PRIOR.format("dst_account"), _PRIOR.format("src_account, dst_account")
_FEATURES = f"""{_LEDGER},
counted AS (
  SELECT *, count(*) OVER ({_SRC}) AS src_n, count(*) OVER ({_DST}) AS dst_n,
         (us - max(us) OVER ({_SRC})) / 1e6 AS src_gap, (us - max(us) OVER ({_DST})) / 1e6 AS dst_gap,
         count(DISTINCT dst_account) OVER ({_SRC}) AS src_u, count(DISTINCT src_account) OVER ({_DST}) AS dst_u,
         ln(1 + amount_paid) - avg(ln(1 + amount_paid)) OVER ({_SRC}) AS dev,
         rank() OVER (PARTITION BY currency_paid ORDER BY amount_paid) - 1 AS less,
         count(*) OVER (PARTITION BY currency_paid, amount_paid) AS equal, count(*) OVER (PARTITION BY currency_paid) AS everyone,
         hour(timestamp) AS h
  FROM ledger),
features AS (
  SELECT *, CASE WHEN src_n >= 3 THEN src_u / CAST(src_n AS DOUBLE) END AS fanout, CASE WHEN dst_n >= 3 THEN dst_u / CAST(dst_n AS DOUBLE) END AS fanin,
         CASE WHEN currency_paid IS NOT NULL THEN (less + (equal + 1) / 2.0) / everyone END AS pct, CASE WHEN src_n >= 3 THEN dev END AS log_dev
  FROM counted),
scored AS (SELECT *, round(pct, 6) AS score FROM features)"""
_RULES = {
    "high_risk_format": "payment_format = 'error'", "structuring_band": "pct BETWEEN 0.55 AND 0.90", "rapid_passthrough": "src_gap <= 60", "dormant_reactivation": "src_gap > 200000",
    "high_fanin": "fanin > 0.667", "amount_spike": "log_dev > 2.0", "business_hours": "h BETWEEN 11 AND 16",
}
_FLAGS = f"""{_FEATURES},
flags AS (SELECT *, {", ".join(f"coalesce({e}, false) AS {n}" for n, e in _RULES.items())} FROM scored),
flagged AS (SELECT *, {" + ".join(f"CAST({n} AS INT)" for n in _RULES)} AS rule_score FROM flags),
totals AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS p FROM flagged)"""

ORACLES: dict[str, str] = {}


def ledger(name: str, body: str, base: str = _LEDGER, more: str = "") -> None:
    ORACLES[name] = f"WITH {base}{',' + more if more else ''}\n{body}"


def features(name: str, body: str, more: str = "") -> None:
    ledger(name, body, _FEATURES, more)


# -- cleaning and enrichment
_CLEAN = f"""{_TRANSFERS},
cleaned AS (
  SELECT txn_id, date_trunc('minute', timestamp) AS timestamp, amount_paid, amount_paid * 0.5 AS amount_received, payment_format, y,
         CAST(CAST(src_account AS BIGINT) % 10 AS VARCHAR) || '_' || src_account AS src_account, CAST(CAST(dst_account AS BIGINT) % 10 AS VARCHAR) || '_' || dst_account AS dst_account,
         'R' || CAST(CAST(src_account AS BIGINT) % 5 AS VARCHAR) AS currency_paid, 'R' || CAST(CAST(dst_account AS BIGINT) % 5 AS VARCHAR) AS currency_received
  FROM transfers WHERE date_trunc('minute', timestamp) < TIMESTAMP '2024-01-28'),
dimension AS (
  SELECT CAST(c_custkey % 10 AS VARCHAR) || '_' || CAST(c_custkey AS VARCHAR) AS account_key,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD', 'MACHINERY') THEN c_mktsegment ELSE 'Other' END AS entity_type,
         CASE WHEN regexp_matches(n_name, '^NATION_(\\d+)$') THEN regexp_extract(n_name, '^NATION_(\\d+)$', 1) ELSE 'Named' END AS bank_country
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0),
merged AS (
  SELECT txn_id, a.entity_type AS src_entity_type, a.bank_country AS src_bank_country, b.entity_type AS dst_entity_type, b.bank_country AS dst_bank_country
  FROM cleaned LEFT JOIN dimension a ON a.account_key = src_account LEFT JOIN dimension b ON b.account_key = dst_account)"""
ledger(
    "clean_ledger",
    f"""SELECT txn_id, epoch_us(timestamp) AS us, src_account, dst_account, {rounded(amount_paid="amount_paid", amount_received="amount_received", amount_delta="amount_paid - amount_received")},
    currency_paid, currency_received, payment_format, y AS is_laundering, src_account = dst_account AS is_self_loop, currency_paid <> currency_received AS is_cross_currency,
    timestamp < (SELECT date_trunc('day', min(timestamp)) + INTERVAL 2 DAY FROM cleaned) AS is_burn_in FROM cleaned""",
    _CLEAN,
)
ledger(
    "dataset_summary",
    f"""SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT src_account FROM ledger UNION SELECT dst_account FROM ledger)) AS unique_accounts,
    {rounded(laundering_rate="avg(y)", self_loop_share="avg(CAST(is_self_loop AS INT))", cross_currency_share="avg(CAST(is_cross_currency AS INT))")},
    CAST(sum(y) AS BIGINT) AS laundering_count, min(us) AS start_us, max(us) AS end_us, CAST(floor((max(us) - min(us)) / 86400000000) AS BIGINT) AS days_covered FROM ledger""",
)
ledger("clean_accounts", "SELECT * FROM dimension", _CLEAN)
ledger("merge_accounts", "SELECT * FROM merged", _CLEAN)
_same = "avg(CAST(coalesce({0} = {1}, false) AS INT))".format
ledger(
    "merge_summary",
    f"""SELECT count(*) AS rows, {rounded(unmatched_src="avg(CAST(src_entity_type IS NULL AS INT))", unmatched_dst="avg(CAST(dst_entity_type IS NULL AS INT))",
    same_country_share=_same("src_bank_country", "dst_bank_country"), same_entity_share=_same("src_entity_type", "dst_entity_type"))},
    count(DISTINCT src_entity_type) AS src_entity_types, count(DISTINCT src_bank_country) AS src_bank_countries FROM merged""",
    _CLEAN,
)
ORACLES["duplicate_keys"] = "SELECT CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS account_key, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1"

# -- history
features("prior_counts", "SELECT txn_id, src_n AS src_txn_count_prior, dst_n AS dst_txn_count_prior FROM features")
features("prior_gaps", f"SELECT txn_id, {rounded(src_secs_since_last='src_gap', dst_secs_since_last='dst_gap', src_secs_since_last_log='ln(1 + src_gap)')} FROM features")
features("running_distinct", "SELECT txn_id, src_u AS src_unique_dst_prior, dst_u AS dst_unique_src_prior FROM features")
features(
    "running_distinct_chunked",
    f"""SELECT txn_id, src_n AS src_txn_count_prior, dst_n AS dst_txn_count_prior, {rounded(src_secs_since_last='src_gap', dst_secs_since_last='dst_gap')},
    src_u AS src_unique_dst_prior, dst_u AS dst_unique_src_prior FROM features""",
)
features("fan_ratios", f"SELECT txn_id, {rounded(src_fanout_ratio='fanout', dst_fanin_ratio='fanin')} FROM features")
features("amount_pct_rank", f"SELECT txn_id, {rounded(amt_pct_ccy='pct')} FROM features")
features("log_deviation", f"SELECT txn_id, {rounded(src_log_dev='log_dev')} FROM features")
_TIME = f"CAST(h AS BIGINT) AS hour, {rounded(hour_sin='sin(2 * pi() * h / 24)', hour_cos='cos(2 * pi() * h / 24)')}, h = 0 AS is_hour_zero"
_THRESHOLDS = "coalesce(src_gap <= 60, false) AS src_rapid_txn, coalesce(src_gap > 200000, false) AS src_dormant_wake, coalesce(fanin > 0.667, false) AS dst_high_fanin"
features("time_features", f"SELECT txn_id, {_TIME} FROM features")
features("threshold_flags", f"SELECT txn_id, {_THRESHOLDS} FROM features")
features(
    "account_features_full",
    f"""SELECT txn_id, src_n AS src_txn_count_prior, dst_n AS dst_txn_count_prior, src_u AS src_unique_dst_prior, dst_u AS dst_unique_src_prior,
    {rounded(src_secs_since_last='src_gap', dst_secs_since_last='dst_gap', src_secs_since_last_log='ln(1 + src_gap)', src_fanout_ratio='fanout', dst_fanin_ratio='fanin', amt_pct_ccy='pct', src_log_dev='log_dev')},
    {_TIME}, {_THRESHOLDS} FROM features""",
)
ledger(
    "rejected_history",
    f"""SELECT txn_id, {rounded(src_amt_mean_prior='m', src_amt_vs_own='amount_paid / nullif(m, 0)', src_log_ratio='CASE WHEN amount_paid / nullif(m, 0) > 0 THEN ln(amount_paid / nullif(m, 0)) END')},
    m IS NULL AS src_is_new FROM (SELECT *, avg(amount_paid) OVER ({_SRC}) AS m FROM ledger)""",
)
ledger("first_rows", "SELECT src_account, arg_min(txn_id, us) AS txn_id FROM ledger GROUP BY src_account")

# -- graph: each day meets the transfers of the days before it
_DAYS = "dated AS (SELECT *, CAST(floor((us - (SELECT min(us) FROM ledger)) / 86400000000) AS BIGINT) AS day FROM ledger), days AS (SELECT DISTINCT day AS d FROM dated)"


def _window(w: int) -> str:
    return f"""
edge{w} AS (SELECT d, e.* FROM days JOIN dated e ON e.day >= d - {w} AND e.day < d),
in{w} AS (
  SELECT dst_account AS node, d, count(DISTINCT src_account) AS in_degree, count(*) AS txn_count_in, sum(amount_paid) AS amt_in_sum, max(amount_paid) AS amt_in_max,
         count(DISTINCT currency_paid) AS unique_currencies_in, count(DISTINCT payment_format) AS unique_formats_in FROM edge{w} GROUP BY 1, 2),
out{w} AS (SELECT src_account AS node, d, count(DISTINCT dst_account) AS out_degree, count(*) AS txn_count_out, sum(amount_paid) AS amt_out_sum FROM edge{w} GROUP BY 1, 2),
pair{w} AS (SELECT DISTINCT d, src_account AS s, dst_account AS t FROM edge{w}),
back{w} AS (SELECT p.*, EXISTS (SELECT 1 FROM pair{w} q WHERE q.d = p.d AND q.s = p.t AND q.t = p.s) AS back FROM pair{w} p),
rec{w} AS (
  SELECT node, d, least(1, greatest(0, sum(CAST(back AS INT)) / 2.0 / count(DISTINCT other))) AS reciprocity
  FROM (SELECT s AS node, t AS other, d, back FROM back{w} UNION ALL SELECT t, s, d, back FROM back{w}) GROUP BY 1, 2),
both{w} AS (
  SELECT coalesce(i.node, o.node) AS node, coalesce(i.d, o.d) AS d, coalesce(in_degree, 0) AS in_degree, coalesce(txn_count_in, 0) AS txn_count_in, coalesce(amt_in_sum, 0) AS amt_in_sum,
         coalesce(amt_in_max, 0) AS amt_in_max, coalesce(unique_currencies_in, 0) AS unique_currencies_in, coalesce(unique_formats_in, 0) AS unique_formats_in,
         coalesce(out_degree, 0) AS out_degree, coalesce(txn_count_out, 0) AS txn_count_out, coalesce(amt_out_sum, 0) AS amt_out_sum
  FROM in{w} i FULL JOIN out{w} o ON i.node = o.node AND i.d = o.d),
node{w} AS (
  SELECT b.*, in_degree / (out_degree + 1.0) AS fan_ratio, CASE WHEN amt_in_sum > 0 THEN amt_out_sum / (amt_in_sum + 1) END AS flow_through,
         CASE WHEN amt_in_sum > 0 THEN amt_in_max / amt_in_sum END AS amt_concentration, reciprocity
  FROM both{w} b LEFT JOIN rec{w} r ON r.node = b.node AND r.d = b.d)"""


_DOUBLE = ("amt_in_sum", "amt_in_max", "amt_out_sum", "fan_ratio", "flow_through", "amt_concentration", "reciprocity")
_COUNT = ("in_degree", "txn_count_in", "unique_currencies_in", "unique_formats_in", "out_degree", "txn_count_out")
for _w in (1, 3, 7):
    ledger(f"graph_nodes_{_w}d", f"SELECT node, d AS day, {', '.join(_COUNT)}, {rounded(**{c: c for c in _DOUBLE})} FROM node{_w}", more=f"{_DAYS},{_window(_w)}")
ledger("reciprocity_7d", f"SELECT node, d AS day, {rounded(reciprocity_7d='reciprocity')} FROM node7", more=f"{_DAYS},{_window(7)}")
ledger(
    "pair_features",
    f"""SELECT txn_id, n AS pair_txn_count_prior, n = 0 AS is_first_interaction, {rounded(pair_amt_log_dev='CASE WHEN n >= 2 THEN dev END')}
    FROM (SELECT txn_id, count(*) OVER ({_PAIR}) AS n, ln(1 + amount_paid) - avg(ln(1 + amount_paid)) OVER ({_PAIR}) AS dev FROM ledger)""",
)
_ALL_WINDOWS = ",".join([_DAYS, *map(_window, (1, 3, 7))])
_JOINS = " ".join(f"LEFT JOIN node{w} {s}{w} ON {s}{w}.node = x.{s}_account AND {s}{w}.d = x.day" for s in ("src", "dst") for w in (1, 3, 7))
_zero = lambda s, m, w: f"coalesce({s}{w}.{m}, 0) AS {s}_{m}_{w}d"
ledger(
    "graph_join_sides",
    "SELECT txn_id, "
    + ", ".join(_zero(s, m, w) for s in ("src", "dst") for m in ("in_degree", "out_degree", "txn_count_in", "txn_count_out") for w in (1, 3, 7))
    + ", "
    + ", ".join(f"{R(f'{s}{w}.{m}')} AS {s}_{m}_{w}d" for s in ("src", "dst") for m in ("fan_ratio", "flow_through", "reciprocity", "amt_concentration") for w in (1, 3, 7))
    + f" FROM dated x {_JOINS}",
    more=_ALL_WINDOWS,
)
ledger(
    "degree_accel",
    "SELECT txn_id, " + rounded(**{f"{s}_{m}_accel": f"CAST(coalesce({s}1.{m}, 0) AS DOUBLE) / nullif(coalesce({s}7.{m}, 0), 0)" for s in ("src", "dst") for m in ("in_degree", "out_degree")}) + f" FROM dated x {_JOINS}",
    more=_ALL_WINDOWS,
)

# -- splits
_SPLIT = """
cuts AS (SELECT CAST(floor(quantile_cont(us, 0.6)) AS BIGINT) AS a, CAST(floor(quantile_cont(us, 0.8)) AS BIGINT) AS b FROM ledger),
parted AS (SELECT *, CASE WHEN us <= a THEN 'train' WHEN us <= b THEN 'val' ELSE 'test' END AS split FROM {} CROSS JOIN cuts)"""
ledger("split_boundaries", "SELECT a AS train_us, b AS val_us FROM cuts", more=_SPLIT.format("ledger"))
ledger("split_summary", f"SELECT split, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, {rounded(rate='avg(y)')}, min(us) AS start_us, max(us) AS end_us FROM parted GROUP BY split", more=_SPLIT.format("ledger"))
ledger("training_rows", "SELECT txn_id, split FROM parted WHERE split = 'test' OR (payment_format NOT IN ('signup', 'view') AND NOT is_self_loop AND NOT is_burn_in)", more=_SPLIT.format("ledger"))
ledger(
    "split_composition",
    f"""SELECT split, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, {rounded(row_share="avg(CAST(payment_format = 'error' AS INT))",
    positive_share="sum(CASE WHEN payment_format = 'error' THEN y ELSE 0 END) / CAST(nullif(sum(y), 0) AS DOUBLE)")} FROM parted GROUP BY split""",
    more=_SPLIT.format("ledger"),
)


# -- rules
def flags(name: str, body: str, more: str = "") -> None:
    ledger(name, body, _FLAGS, more)


def _effects(fired: str, caught: str) -> dict[str, str]:
    precision = f"CAST({caught} AS DOUBLE) / nullif({fired}, 0)"
    return {"precision": precision, "recall": f"CAST({caught} AS DOUBLE) / nullif(p, 0)", "lift": f"({precision}) / nullif(CAST(p AS DOUBLE) / n, 0)"}


_SINGLE = "single AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST(count(*) FILTER ({r}) AS BIGINT) AS f, CAST(coalesce(sum(y) FILTER ({r}), 0) AS BIGINT) AS c FROM flagged" for r in _RULES) + ")"
flags("rule_flags", f"SELECT txn_id, {', '.join(_RULES)} FROM flagged")
flags("rule_scores", "SELECT txn_id, CAST(rule_score AS BIGINT) AS rule_score, rule_score > 0 AS any_rule FROM flagged")
flags("rule_individual", f"SELECT rule, f AS fired, {rounded(fired_pct='CAST(f AS DOUBLE) / n', **_effects('f', 'c'))}, c AS caught FROM single CROSS JOIN totals", _SINGLE)
flags("rule_weak", f"SELECT rule, lift FROM (SELECT rule, {rounded(lift=_effects('f', 'c')['lift'])}, {_effects('f', 'c')['lift']} AS l FROM single CROSS JOIN totals) WHERE l < 1.2", _SINGLE)


def _combined(score: str, most: int) -> str:
    steps = f"""steps AS (SELECT t AS threshold, count(*) FILTER ({score} >= t) AS a, CAST(coalesce(sum(y) FILTER ({score} >= t), 0) AS BIGINT) AS c
    FROM flagged CROSS JOIN (SELECT CAST(unnest(range(1, {most + 1})) AS BIGINT) AS t) GROUP BY t)"""
    return f"WITH {_FLAGS}, {steps} SELECT threshold, a AS alerts, {rounded(alert_rate='CAST(a AS DOUBLE) / n', **_effects('a', 'c'))}, c AS caught FROM steps CROSS JOIN totals"


ORACLES["rule_combined"] = _combined("rule_score", 7)
ORACLES["rule_ablation"] = _combined("(rule_score - CAST(business_hours AS INT))", 6)


def _top(score: str, ks: tuple[int, ...], name: str) -> str:
    return f"""{name} AS (
  SELECT CAST(k AS BIGINT) AS k, CAST(sum(y) FILTER (place <= k) AS BIGINT) AS c
  FROM (SELECT y, row_number() OVER (ORDER BY {score} DESC NULLS LAST, (txn_id * 2654435761) % 1000003, txn_id) AS place FROM flagged)
  CROSS JOIN (SELECT DISTINCT least(u.k, totals.n) AS k FROM (SELECT unnest({list(ks)}) AS k) u CROSS JOIN totals) GROUP BY k)"""


_AT = _effects("k", "c")
flags("rule_precision_at_k", f"SELECT k, c AS caught, {rounded(precision_at_k=_AT['precision'], recall_at_k=_AT['recall'], lift=_AT['lift'])} FROM best CROSS JOIN totals", _top("rule_score", (100, 500, 1000), "best"))
flags("recall_at_k", f"SELECT k, c AS caught, {rounded(**_AT)} FROM best CROSS JOIN totals", _top("score", (100, 500, 1000, 5000), "best"))
flags(
    "model_vs_rules_at_k",
    f"""SELECT m.k, m.c AS model_caught, r.c AS rules_caught, {rounded(model_precision='CAST(m.c AS DOUBLE) / m.k', rules_precision='CAST(r.c AS DOUBLE) / r.k', improvement='CAST(m.c AS DOUBLE) / nullif(r.c, 0)')}
    FROM m JOIN r ON m.k = r.k""",
    _top("score", (100, 500, 1000, 5000), "m") + "," + _top("rule_score", (100, 500, 1000, 5000), "r"),
)

# -- ranking metrics
_CURVE = """
byscore AS (SELECT score, count(*) AS n_here, sum(y) AS p_here FROM flagged WHERE score IS NOT NULL GROUP BY score),
curve AS (SELECT score, p_here, sum(n_here) OVER (ORDER BY score DESC) AS a, sum(p_here) OVER (ORDER BY score DESC) AS tp FROM byscore)"""
_AP = "sum(CAST(p_here AS DOUBLE) / p * tp / a)"
_AUC = "auc AS (SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * CAST(count(*) FILTER (y = 0) AS DOUBLE)) AS v FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM flagged))"
flags("ap_score", f"SELECT {rounded(pr_auc=_AP)} FROM curve CROSS JOIN totals", _CURVE)
flags("roc_auc", f"SELECT {rounded(roc_auc='v')} FROM auc", _AUC)
flags("pr_curve", f"SELECT {rounded(threshold='score', precision='CAST(tp AS DOUBLE) / a', recall='CAST(tp AS DOUBLE) / p')}, CAST(a AS BIGINT) AS alerts FROM curve CROSS JOIN totals", _CURVE)
flags(
    "threshold_at_recall",
    f"SELECT {rounded(threshold='score', val_precision='CAST(tp AS DOUBLE) / a', val_recall='CAST(tp AS DOUBLE) / p', target_recall='CAST(0.6 AS DOUBLE)')} FROM curve CROSS JOIN totals WHERE CAST(tp AS DOUBLE) / p >= 0.6 ORDER BY score DESC LIMIT 1",
    _CURVE,
)
flags(
    "operating_point",
    f"""SELECT {rounded(threshold='CAST(0.5 AS DOUBLE)', alert_rate='CAST(a AS DOUBLE) / n', precision='CAST(tp AS DOUBLE) / nullif(a, 0)', recall='CAST(tp AS DOUBLE) / nullif(p, 0)', alerts_per_catch='CAST(a AS DOUBLE) / nullif(tp, 0)')},
    a AS alerts, tp AS true_positives, a - tp AS false_positives, p - tp AS false_negatives
    FROM (SELECT count(*) FILTER (score >= 0.5) AS a, CAST(sum(y) FILTER (score >= 0.5) AS BIGINT) AS tp FROM flagged) CROSS JOIN totals""",
)
flags(
    "segment_recall",
    f"""SELECT payment_format AS segment, rows, positives, caught, alerts, {rounded(recall='CAST(caught AS DOUBLE) / nullif(positives, 0)', precision='CAST(caught AS DOUBLE) / nullif(alerts, 0)')}
    FROM (SELECT payment_format, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, count(*) FILTER (score >= 0.5 AND y = 1) AS caught, count(*) FILTER (score >= 0.5) AS alerts FROM flagged GROUP BY 1)""",
)
_BINS = "edges AS (SELECT quantile_cont({0}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM {1}), binned AS (SELECT *, CAST(len(list_filter(q, lambda e: e < {0})) AS BIGINT) AS bin FROM {1} CROSS JOIN edges WHERE {0} IS NOT NULL)"
flags("calibration_deciles", f"SELECT bin, count(*) AS n, {rounded(mean_predicted='avg(score)', observed_rate='avg(y)', gap='avg(score) - avg(y)')} FROM binned GROUP BY bin", _BINS.format("score", "flagged"))
flags("brier", f"SELECT {rounded(brier='avg((score - y) * (score - y))')} FROM flagged")
flags(
    "headline_metrics",
    f"SELECT {rounded(pr_auc='ap', roc_auc='v', base_rate='CAST(p AS DOUBLE) / n', vs_baseline='ap / 0.0126', vs_random='ap / (CAST(p AS DOUBLE) / n)')} FROM (SELECT {_AP} AS ap FROM curve CROSS JOIN totals) CROSS JOIN auc CROSS JOIN totals",
    f"{_CURVE}, {_AUC}",
)

# -- exploration
_LIFT = "SELECT CAST({0} AS VARCHAR) AS value, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, " + rounded(rate="avg(y)", share="CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM ledger)", lift="avg(y) / (SELECT avg(y) FROM ledger)") + " FROM ledger WHERE {0} IS NOT NULL GROUP BY 1"
ledger("cat_lift", _LIFT.format("payment_format"))
ledger("cat_lift_having", _LIFT.format("dst_account") + " HAVING count(*) >= 100")
ledger("bool_lift", f"SELECT * EXCLUDE (share) FROM ({_LIFT.format('is_cross_currency')})")
ledger("zero_positive", "SELECT src_account AS value, count(*) AS n FROM ledger GROUP BY 1 HAVING sum(y) = 0")
ledger(
    "numeric_describe",
    "SELECT y AS class, count(amount_paid) AS count, "
    + rounded(mean="avg(amount_paid)", std="stddev_samp(amount_paid)", min="min(amount_paid)", max="max(amount_paid)", **{f"p{q}": f"quantile_cont(amount_paid, 0.{q})" for q in (25, 50, 75, 95, 99)})
    + " FROM ledger GROUP BY y",
)
ledger("decile_rates", f"SELECT bin, count(*) AS n, {rounded(rate='avg(y)')} FROM binned GROUP BY bin", more=_BINS.format("amount_paid", "ledger"))
_UNIT = "SELECT '{0}' AS unit, CAST({1} AS BIGINT) AS value, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, " + rounded(rate="avg(y)") + " FROM ledger GROUP BY 2"
ledger("temporal_rollup", _UNIT.format("hour", "hour(timestamp)") + " UNION ALL " + _UNIT.format("dayofweek", "isodow(timestamp) - 1"))
ledger("daily_rollup", f"SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, {rounded(rate='avg(y)')} FROM ledger GROUP BY 1")
ORACLES["column_profile"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS column, CASE any_value(typeof({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(any_value(typeof({c}))) END AS dtype, count(*) - count({c}) AS nulls, {R(f'1.0 - count({c}) / CAST(count(*) AS DOUBLE)')} AS null_pct, count(DISTINCT {c}) AS unique,
    {R(f'count(DISTINCT {c}) / CAST(count(*) AS DOUBLE)')} AS unique_pct, min(CAST({c} AS VARCHAR)) AS example, count(DISTINCT {c}) <= 1 AS is_constant, count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) > 0.9 AS is_identifier FROM customer"""
    for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
)
ledger("target_balance", f"SELECT count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, {rounded(rate='avg(y)', imbalance='CAST(count(*) - sum(y) AS DOUBLE) / nullif(sum(y), 0)')} FROM ledger")
ledger("currency_stats", f"""SELECT currency_paid AS "group", count(*) AS n, {rounded(median='median(amount_paid)', p95='quantile_cont(amount_paid, 0.95)')}, count(DISTINCT src_account) AS distinct FROM ledger GROUP BY 1""")
features(
    "threshold_sweep",
    f"""SELECT {rounded(threshold='t', lift='avg(y) FILTER (src_gap > t) / (SELECT avg(y) FROM features)')}, count(*) FILTER (src_gap > t) AS n, CAST(coalesce(sum(y) FILTER (src_gap > t), 0) AS BIGINT) AS positives
    FROM features CROSS JOIN (SELECT CAST(unnest([40000, 80000, 200000, 300000]) AS DOUBLE) AS t) GROUP BY t""",
)
ledger("value_counts", "SELECT currency_received AS value, count(*) AS n FROM ledger GROUP BY 1")
features("missingness", f"SELECT log_dev IS NULL AS is_missing, count(*) AS n, {rounded(rate='avg(y)')} FROM features GROUP BY 1")
features(
    "conditional_rates",
    f"""SELECT split, {rounded(dormant_share='avg(CAST(coalesce(src_gap > 200000, false) AS INT))', dormant_rate='avg(y) FILTER (src_gap > 200000)', error_share="avg(CAST(payment_format = 'error' AS INT))",
    error_rate="avg(y) FILTER (payment_format = 'error')")} FROM parted GROUP BY split""",
    _SPLIT.format("features"),
)
ledger("log_histogram", "SELECT y AS class, CAST(least(49, floor(log10(1 + amount_paid) / 0.24)) AS BIGINT) AS bin, count(*) AS n FROM ledger WHERE amount_paid >= 0 GROUP BY 1, 2")
ledger("logz_by_currency", f"SELECT txn_id, {rounded(amt_logz_ccy='(ln(1 + amount_paid) - avg(ln(1 + amount_paid)) OVER w) / nullif(stddev_samp(ln(1 + amount_paid)) OVER w, 0)')} FROM ledger WINDOW w AS (PARTITION BY currency_paid)")
ledger("crosstab_2x2", "SELECT CAST(is_cross_currency AS VARCHAR) AS a, CAST(y AS VARCHAR) AS b, count(*) AS n FROM ledger GROUP BY 1, 2")
ledger(
    "chi2_yates",
    f"""SELECT {rounded(chi2='(a+b+c+d) * power(greatest(0, abs(a*d - b*c) - (a+b+c+d) / 2), 2) / ((a+b) * (c+d) * (a+c) * (b+d))')} FROM (
    SELECT CAST(count(*) FILTER (NOT is_cross_currency AND y = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT is_cross_currency AND y = 1) AS DOUBLE) AS b,
           CAST(count(*) FILTER (is_cross_currency AND y = 0) AS DOUBLE) AS c, CAST(count(*) FILTER (is_cross_currency AND y = 1) AS DOUBLE) AS d FROM ledger)""",
)
_hyper = "exp(lgamma(a+b+1) - lgamma({0}+1) - lgamma(a+b-{0}+1) + lgamma(c+d+1) - lgamma(a+c-{0}+1) - lgamma(c+d-a-c+{0}+1) - lgamma(a+b+c+d+1) + lgamma(a+c+1) + lgamma(b+d+1))"
_NUMBERS = {"amount_paid": "amount_paid", "amt_pct_ccy": "pct", "src_log_dev": "log_dev", "src_secs_since_last": "src_gap"}


def _pairs(names: tuple[str, ...], one) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {one(_NUMBERS[a], _NUMBERS[b])}" for i, a in enumerate(names) for b in names[i + 1 :])


_rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0".format
features("pearson_pairs", _pairs(tuple(_NUMBERS), lambda a, b: f"{rounded(r=f'corr({a}, {b})')} FROM features"))
features(
    "spearman_pairs",
    _pairs(("amount_paid", "src_log_dev", "src_secs_since_last"), lambda a, b: f"{rounded(r='corr(x, z)')} FROM (SELECT {_rank(a)} AS x, {_rank(b)} AS z FROM features WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"),
)
ledger(
    "fisher_exact",
    f"""SELECT {rounded(odds_ratio="a * d / nullif(b * c, 0)", p_value="least(1, sum(x) FILTER (x <= own * (1 + 1e-7)))")} FROM (
    SELECT a, b, c, d, {_hyper.format("a")} AS own, {_hyper.format("k")} AS x
    FROM (SELECT *, unnest(generate_series(CAST(greatest(0, a + c - (c + d)) AS BIGINT), CAST(least(a + b, a + c) AS BIGINT))) AS k FROM cells)) GROUP BY a, b, c, d""",
    more="""cells AS (
    SELECT CAST(count(*) FILTER (NOT is_cross_currency AND y = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT is_cross_currency AND y = 1) AS DOUBLE) AS b,
           CAST(count(*) FILTER (is_cross_currency AND y = 0) AS DOUBLE) AS c, CAST(count(*) FILTER (is_cross_currency AND y = 1) AS DOUBLE) AS d FROM ledger)""",
)
features("strong_pairs", f"SELECT a, b, {R('v')} AS r FROM ({_pairs(tuple(_NUMBERS), lambda a, b: f'(SELECT corr({a}, {b}) FROM features) AS v')}) WHERE abs(v) > 0.05")
features(
    "vif",
    'SELECT x.column, ' + rounded(vif="1 / (1 - (p * p + q * q - 2 * p * q * r) / (1 - r * r))") + """ FROM (
    SELECT 'amount_paid' AS column, ab AS p, ac AS q, bc AS r FROM pairwise UNION ALL SELECT 'amt_pct_ccy', ab, bc, ac FROM pairwise UNION ALL SELECT 'src_secs_since_last', ac, bc, ab FROM pairwise) x""",
    "pairwise AS (SELECT corr(amount_paid, pct) AS ab, corr(amount_paid, src_gap) AS ac, corr(pct, src_gap) AS bc FROM features WHERE pct IS NOT NULL AND src_gap IS NOT NULL AND amount_paid IS NOT NULL)",
)
ledger("plot_sample", "SELECT y AS class, CASE WHEN y = 1 THEN count(*) ELSE least(500, count(*)) END AS n FROM ledger GROUP BY y")
features(
    "feature_projection",
    f"""SELECT {rounded(amt_pct_ccy='pct', src_secs_since_last_log='ln(1 + src_gap)', dst_fanin_ratio='fanin', src_fanout_ratio='fanout', src_log_dev='log_dev', hour_sin='sin(2 * pi() * h / 24)', hour_cos='cos(2 * pi() * h / 24)')},
    {_THRESHOLDS}, h = 0 AS is_hour_zero, payment_format, src_entity_type, dst_entity_type, src_bank_country, dst_bank_country FROM features LEFT JOIN merged USING (txn_id)""",
    _CLEAN.removeprefix(_TRANSFERS + ",\n"),
)

# -- guards
_MOMENT = "date_trunc('minute', timestamp) >= TIMESTAMP '2024-01-28'"
ledger(
    "tail_summary",
    f"""SELECT count(*) AS rows, count(*) FILTER ({_MOMENT}) AS dropped, CAST(coalesce(sum(y) FILTER ({_MOMENT}), 0) AS BIGINT) AS dropped_positives,
    {rounded(dropped_rate=f"CAST(sum(y) FILTER ({_MOMENT}) AS DOUBLE) / nullif(count(*) FILTER ({_MOMENT}), 0)")} FROM transfers""",
)
ledger("rows_after_merge", "SELECT (SELECT count(*) FROM cleaned) AS before, (SELECT count(*) FROM merged) AS after", _CLEAN)
_KEPT = "kept AS (SELECT * FROM parted WHERE split = 'test' OR (payment_format NOT IN ('signup', 'view') AND NOT is_self_loop AND NOT is_burn_in))"
ledger(
    "split_faults",
    """SELECT split, sum(y) = 0 AS no_positive, sum(y) < 1000 AS few_positives,
    coalesce(max(us) > CASE split WHEN 'train' THEN (SELECT min(us) FROM kept WHERE split = 'val') WHEN 'val' THEN (SELECT min(us) FROM kept WHERE split = 'test') END, false) AS overlaps_next
    FROM kept GROUP BY split""",
    more=_SPLIT.format("ledger") + ", " + _KEPT,
)
ledger(
    "two_way_split",
    "SELECT CASE WHEN us <= a THEN 'fit' ELSE 'held_out' END AS split, count(*) AS rows, max(us) AS end_us FROM ledger CROSS JOIN cut GROUP BY 1",
    more="cut AS (SELECT CAST(floor(quantile_cont(us, 0.7)) AS BIGINT) AS a FROM ledger)",
)
ORACLES["name_numbers"] = "SELECT c_custkey, " + R("CAST(nullif(regexp_extract(c_name, '#(\\d+)', 1), '') AS DOUBLE)") + " AS number FROM customer"
flags(
    "blind_segments",
    f"""SELECT segment, positives, {rounded(recall='CAST(caught AS DOUBLE) / positives')} FROM (
    SELECT currency_paid AS segment, CAST(sum(y) AS BIGINT) AS positives, count(*) FILTER (score >= 0.9 AND y = 1) AS caught FROM flagged WHERE currency_paid IS NOT NULL GROUP BY 1)
    WHERE positives >= 20 AND CAST(caught AS DOUBLE) / positives < 0.2""",
)

# -- preparing models
_PREPARED = {"src_secs_since_last_log": "ln(1 + src_gap)", "src_log_dev": "log_dev", "dst_fanin_ratio": "fanin", "src_fanout_ratio": "fanout", "amt_pct_ccy": "pct"}
features("prepared_medians", " UNION ALL ".join(f"SELECT '{c}' AS column, {rounded(median=f'median({x})')} FROM features" for c, x in _PREPARED.items()))
_FREQUENT = "frequent AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, coalesce({c}, 'Unknown') AS value FROM ledger GROUP BY 1, 2 HAVING count(*) >= 0.015 * (SELECT count(*) FROM ledger)" for c in ("payment_format", "currency_paid", "dst_account")
) + ")"
ledger("prepared_categories", "SELECT * FROM frequent", more=_FREQUENT)
features(
    "prepared_rows",
    "SELECT txn_id, "
    + ", ".join(f"{R(f'coalesce({x}, (SELECT median({x}) FROM features))')} AS n_{c}, {R(f'CAST(CAST({x} IS NULL AS INT) AS DOUBLE)')} AS m_{c}" for c, x in list(_PREPARED.items())[:3])
    + ", " + rounded(b_src_rapid_txn="CAST(CAST(coalesce(src_gap <= 60, false) AS INT) AS DOUBLE)") + ", "
    + ", ".join(f"CASE WHEN coalesce({c}, 'Unknown') IN (SELECT value FROM frequent WHERE frequent.column = '{c}') THEN coalesce({c}, 'Unknown') ELSE '__infrequent__' END AS c_{c}" for c in ("payment_format", "currency_paid", "dst_account"))
    + " FROM features",
    _FREQUENT,
)
ledger("class_weights", f"SELECT y AS class, {rounded(weight='(SELECT count(*) FROM ledger) / (2.0 * count(*))')} FROM ledger GROUP BY y")
ledger(
    "fold_sizes",
    """SELECT CAST(f AS BIGINT) AS fold, (SELECT count(*) FROM ledger WHERE us <= q[f + 1]) AS train, (SELECT count(*) FROM ledger WHERE us > q[f + 1] AND (f = 2 OR us <= q[f + 2])) AS test
    FROM (SELECT list_transform(quantile_cont(us, [0.25, 0.5, 0.75]), lambda x: CAST(floor(x) AS BIGINT)) AS q FROM ledger) CROSS JOIN (SELECT unnest(range(0, 3)) AS f)""",
)
ORACLES["top_run"] = f"SELECT CAST(s_suppkey AS VARCHAR) AS run_id, s_name AS name, {R('CAST(s_acctbal AS DOUBLE)')} AS pr_auc FROM supplier WHERE s_name NOT LIKE '%7%' ORDER BY s_acctbal DESC, run_id LIMIT 1"

# -- sinks and back
ledger(
    "csv_ledger",
    f"""SELECT epoch_us(timestamp) AS us, src_account, dst_account, {rounded(amount_paid="amount_paid")}, currency_paid, payment_format, y AS is_laundering, src_account = dst_account AS is_self_loop,
    timestamp < (SELECT date_trunc('day', min(timestamp)) + INTERVAL 2 DAY FROM cleaned) AS is_burn_in FROM cleaned""",
    _CLEAN,
)
ledger("split_sink", "SELECT split, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, min(us) AS start_us, max(us) AS end_us FROM kept WHERE split = 'val' GROUP BY split", more=_SPLIT.format("ledger") + ", " + _KEPT)
ledger("stage_sink", f"SELECT txn_id, {R('round(CAST(CAST(amount_paid AS FLOAT) AS DOUBLE), 1)')} AS amount_paid FROM ledger")
ledger("report_sink", f"SELECT value, n, lift FROM ({_LIFT.format('payment_format')})")

# -- streams
_LOGS = "avg(ln(1 + amount_paid)) OVER"
for _side, _other, _w in (("src", "dst", _SRC), ("dst", "src", _DST)):
    features(
        f"stream_prior_{_side}",
        f"""SELECT txn_id, {_side}_n AS {_side}_txn_count_prior, {_side}_u AS {_side}_unique_{_other}_prior, {rounded(**{f'{_side}_secs_since_last': f'{_side}_gap', f'{_side}_log_mean_prior': 'm'})}
        FROM (SELECT *, {_LOGS} ({_w}) AS m FROM features)""",
    )
ledger(
    "stream_windows",
    f"""SELECT dst_account AS account, day_us, count(*) AS n, {rounded(amount='sum(amount_paid)', largest='max(amount_paid)')}, count(DISTINCT src_account) AS partners
    FROM (SELECT *, (us // 86400000000 + unnest([1, 2, 3])) * 86400000000 AS day_us FROM ledger) GROUP BY 1, 2""",
)
