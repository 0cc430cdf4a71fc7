"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = rf"""
WITH lines AS (
  SELECT rowid_ AS r, doc_id, u.i, u.line,
         {_LOWER.format("trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, coalesce(text, '') AS text FROM documents) d,
       LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS i) u),
keys AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT l.*, coalesce(l.doc_id <> keys.keeper, false) AS gone FROM lines l LEFT JOIN keys ON l.k = keys.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""

OP8 = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut),
rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT p.page_id, p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT row_number() OVER () AS n, * FROM parts) p
  LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.n, p.page_id, p.host, p.path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""

OP9 = rf"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
places AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (
  SELECT p.r, p.i, w.n, w.item FROM places p JOIN windows w ON p.phrase = w.phrase AND p.n = w.n),
hits AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

OP5 = """
WITH given AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
usable AS (
  SELECT * FROM given
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM usable q JOIN usable c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_PLACES = """
  SELECT r, i - 1 AS place, '{label}' AS label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs)
  WHERE w[i : i + {last}] = {words}"""
_PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
LICENSE_BASE = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
places AS ({" UNION ALL ".join(_PLACES.format(label=label, last=len(words) - 1, words=words) for label, words in _PHRASES.items())}),
found AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels
FROM docs LEFT JOIN found USING (r)
"""

_ALL = "regexp_extract_all(coalesce(text, ''), '{}')".format
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE
    WHEN (length({_DIGITS}) - i) % 2 = 1 THEN CAST(substr({_DIGITS}, i + 1, 1) AS INT)
    ELSE (CAST(substr({_DIGITS}, i + 1, 1) AS INT) * 2) // 10 + (CAST(substr({_DIGITS}, i + 1, 1) AS INT) * 2) % 10 END)) % 10 = 0"""
PII_BASE = rf"""
SELECT doc_id, CAST(len({_ALL(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")}) AS BIGINT) AS n_email,
  CAST(len(list_filter({_ALL(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")}, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(p, 3) AS INT) > 255)) = 0)) AS BIGINT) AS n_ip,
  CAST(len(list_filter({_ALL("[0-9]([ -]?[0-9])+")}, lambda x: length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN})) AS BIGINT) AS n_card,
  CAST(len(list_filter({_ALL(r"\+[0-9][ ().0-9-]+[0-9]")}, lambda x: length({_DIGITS}) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone
FROM documents
"""

ORACLES = {"license_base": LICENSE_BASE, "pii_base": PII_BASE, "op3_line_dedup": OP3, "op5_vp_search": OP5, "op8_url_filter": OP8, "op9_decontaminate": OP9}
