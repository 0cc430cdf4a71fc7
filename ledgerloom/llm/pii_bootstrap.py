"""Personal data: fixed patterns seed entities, whose contexts lead to unseen identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, field, map_batches, materialize, plain

KINDS = ("email", "ip", "card", "phone")
#: The method's own kind: keys and passwords. What is assigned to one of these names seeds it.
SECRET = len(KINDS)
ALL_KINDS = (*KINDS, "secret")
SECRET_NAMES = ("token", "secret", "password", "passwd", "api key", "access key", "private key", "auth key")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_HANDLE = re.compile(r"[A-Za-z0-9-]+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9])+")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_DIGIT = re.compile(r"[0-9]")
_NAMES = "|".join(n.replace(" ", "[\x20_-]?") for n in SECRET_NAMES)
_ASSIGNED = re.compile(rf"(?<![A-Za-z0-9])(?:{_NAMES})[\"']?\x20{{0,3}}(?:=>|:=|=|:)\x20{{0,3}}[\"']?([A-Za-z0-9+/_=-]{{16,}})", re.IGNORECASE)
_KEY = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_LETTER = re.compile(r"[A-Za-z]")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[^\w]*$")


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def at_signs(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole address?) around each ``@``: the leftmost non-overlapping addresses, and
    handles whose domain has no dot. Goes from sign to sign, so it is linear in the text."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            m = _DOMAIN.match(text, at + 1)
            whole = m is not None
            m = m or _HANDLE.match(text, at + 1)
            if m is not None:
                out.append((start, m.end(), whole))
                if whole:
                    done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, sorted. Of each kind the leftmost
    non-overlapping matches; those that fail the kind's check are dropped and not tried again."""
    out = [(a, 0, b) for a, b, whole in at_signs(text) if whole] if "@" in text else []
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            if m[0].count(".") < 3:
                continue
            parts = m[0].split(".")
            start = m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                    out.append((start, 1, end))
                start = end + 1
        for m in _CARD.finditer(text):
            digits = digits_of(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(digits_of(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def like_key(text: str) -> bool:
    """Whether 16 or more characters of a run look drawn rather than written: four digits and four letters."""
    return len(_DIGIT.findall(text)) >= 4 and len(_LETTER.findall(text)) >= 4


def assigned_secrets(text: str) -> list[tuple[int, int]]:
    """Places of key-like values that are assigned to one of SECRET_NAMES, in any case."""
    return [m.span(1) for m in _ASSIGNED.finditer(text) if like_key(m[1])]


def class_of(text: str) -> str:
    """Handle, dotted quad, key, or any other number."""
    return "handle" if "@" in text else "quad" if _QUAD.fullmatch(text) else "key" if _LETTER.search(text) else "number"


def fits_of(text: str) -> int:
    """The kinds a candidate can be of, as bits."""
    kind = class_of(text)
    if kind != "number":
        return 1 << {"handle": KINDS.index("email"), "quad": KINDS.index("ip"), "key": SECRET}[kind]
    n = len(digits_of(text))
    return (12 <= n <= 19) << KINDS.index("card") | (7 <= n <= 15) << KINDS.index("phone")


def candidate_spans(text: str) -> list[tuple[int, int]]:
    """Identifier-like strings: numbers of 7 digits or more, handles without a dot, and keys."""
    out = [(a, b) for a, b, whole in at_signs(text) if not whole] if "@" in text else []
    if _DIGIT.search(text):
        out += [m.span() for m in _KEY.finditer(text) if like_key(m[0])]
        for m in _NUMBER.finditer(text):
            if 7 <= len(digits_of(m[0])) <= 24:
                plus = m.start() > 0 and text[m.start() - 1] == "+"
                out.append((m.start() - plus, m.end()))
    return out


def contexts(text: str, start: int, end: int, reach: int = 40) -> list[str]:
    """Lexical patterns of a place: the word before and the class, alone and with the word that
    follows, within ``reach`` code points on either side. Without a word before there is none."""
    m = _WORD_BEFORE.search(text, max(0, start - reach), start)
    if m is None:
        return []
    left = f"{m[1].lower()}|{class_of(text[start:end])}"
    after = re.match(r"\W*([^\W\d_]+)", text[end : end + reach])
    return [left] + ([f"{left}|{after[1].lower()}"] if after else [])


def _number(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def examine(text: bytes, reach: int = 40) -> tuple:
    """Counts of the base kinds, their spans, the spans of assigned secrets, and (start, end, kind or
    -1, fitting kinds, instance, pattern) of every context of seeds and candidates; a candidate
    without a context has no pattern."""
    whole = text.decode("utf-8", "replace")
    base = base_spans(whole)
    mentions, seeds = [], []
    if base or "@" in whole or _DIGIT.search(whole):
        taken = sorted((a, b) for a, _, b in base)

        def free(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
            i = 0
            for a, b in spans:
                while i < len(taken) and taken[i][1] <= a:
                    i += 1
                if i == len(taken) or taken[i][0] >= b:
                    yield a, b

        seeds = list(free(assigned_secrets(whole)))
        found = [(a, b, k) for a, k, b in base] + [(a, b, SECRET) for a, b in seeds]
        taken = sorted(taken + seeds)
        found += [(a, b, -1) for a, b in free(sorted(candidate_spans(whole)))]
        for a, b, k in found:
            instance = _number(whole[a:b])
            fits = 1 << k if k >= 0 else fits_of(whole[a:b])
            about = [_number(p) for p in contexts(whole, a, b, reach)] or [None]
            mentions += [{"start": a, "end": b, "kind": k, "fits": fits, "instance": instance, "pattern": p} for p in about]
    counts = [sum(1 for _, k, _ in base if k == kind) for kind in range(len(KINDS))]
    return (*counts, [{"start": a, "kind": k, "end": b} for a, k, b in base], [{"start": a, "kind": SECRET, "end": b} for a, b in seeds], mentions)


def confident_patterns(mentions: DataFrame, rounds: int | None = None, min_support: int = 5, min_score: float = 0.9) -> DataFrame:
    """(pattern, kind, score) after scoring the graph of patterns and instances until no new pattern
    turns confident, or ``rounds`` times.

    ``mentions``: distinct (pattern, instance, kind, fits), where kind is null for a candidate and
    fits has the bits of the kinds it can be of. Seeds are sure of their kind. A pattern's score for
    a kind is its instances' confidence in the kind over that in any kind and the number of its
    candidates that can't be of the kind; candidates nothing is known of don't count. With
    ``min_support`` instances' confidence and ``min_score`` it is confident, and stays so. A
    candidate's confidence is that of at least one of its confident patterns being right.
    """
    names = [f"c{k}" for k in range(len(ALL_KINDS))]
    bad = [f"b{k}" for k in range(len(ALL_KINDS))]
    seeds = mentions.filter("kind is not null")
    unseen = mentions.filter("kind is null").select("pattern", "instance", "fits")

    def fit(k):
        return F.col("fits").bitwiseAND(F.lit(1 << k)) != 0

    sure = seeds.select("pattern", *[(F.col("kind") == k).cast("double").alias(n) for k, n in enumerate(names)], *[F.lit(0.0).alias(n) for n in bad])
    against = [(~fit(k)).cast("double").alias(n) for k, n in enumerate(bad)]
    confidence = unseen.select("pattern", *[F.lit(0.0).alias(n) for n in names], *against)
    best, known, done = None, 0, 0
    while True:
        scored = sure.union(confidence).groupBy("pattern").agg(*[F.sum(n).alias(n) for n in (*names, *bad)])
        whole = sum((F.col(n) for n in names[1:]), F.col(names[0]))
        tried = [F.when(F.col(n) >= min_support, F.col(n) / (whole + F.col(f"b{k}"))).otherwise(0.0) for k, n in enumerate(names)]
        top = F.greatest(*tried)
        kind = F.coalesce(*[F.when(t == top, F.lit(k)) for k, t in enumerate(tried)])
        found = scored.select("pattern", kind.alias("kind"), top.alias("score")).filter(F.col("score") >= min_score)
        if best is not None:
            found = best.union(found.join(best.select("pattern"), "pattern", "left_anti"))
        best = materialize(found)
        done, before, known = done + 1, known, best.count()
        if known == before or done == rounds:
            return best
        by = unseen.join(best, "pattern").groupBy("instance").agg(
            *[(1 - F.exp(F.sum(F.when((F.col("kind") == k) & fit(k), F.log(F.lit(1.000001) - 0.99 * F.col("score"))).otherwise(0.0)))).alias(n) for k, n in enumerate(names)]
        )
        confidence = unseen.join(by, "instance", "left").select("pattern", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names], *against)


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None, min_support: int = 5, min_score: float = 0.9, reach: int = 40
) -> DataFrame:
    """The id, n_email, n_ip, n_card, n_phone, base_spans, spans, n_secret and n_spans of every row.

    base_spans and spans are ``kind:start:end`` by start, then kind as listed, comma-joined;
    offsets are code points, ends exclusive. base_spans has the fixed patterns' matches and the
    counts count them; spans also has the method's: assigned secrets, other places of the same
    key, and candidates that a confident pattern finds, of the kind of the best one among the
    kinds they fit. A pattern's words lie within ``reach`` code points of the candidate. n_secret
    counts the secrets and n_spans all of spans.

    Null and empty texts have no spans; null ids and repeated rows stay; an empty table gives
    none; other columns are not read. Texts are read once: what is found in them, which is small,
    waits in the shared folder. Patterns and instances are only ever joined and averaged, so a
    context that a third of all places share is no group that a task gathers.
    """
    long, integer = T.LongType(), T.IntegerType()
    base = T.ArrayType(T.StructType([field("start", long), field("kind", integer), field("end", long)]))
    mention = T.ArrayType(T.StructType([field("start", long), field("end", long), field("kind", integer), field("fits", integer), field("instance", long), field("pattern", long)]))
    counted = [f"n_{k}" for k in KINDS]
    aside = [f"__{c}" for c in counted]
    added = [*[field(c, long) for c in aside], field("__base", base), field("__seeds", base), field("__mentions", mention), field("__row", T.BinaryType())]

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = as_bytes(batch.column(batch.schema.get_field_index(text_col)))
        ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
        rows = [examine(t, reach) for t in texts]
        spans = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        seen = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("fits", pa.int32()), ("instance", pa.int64()), ("pattern", pa.int64())]))
        kinds = [*[pa.int64()] * len(KINDS), spans, spans, seen]
        return [*[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], pa.array([xxhash.xxh3_128_digest(f"{i}:".encode() + t) for i, t in zip(ids, texts, strict=True)], pa.binary())]

    found = materialize(map_batches(plain(docs, id_col, text_col), added, lambda: run, [id_col]))
    every = found.select("__row", F.explode("__mentions").alias("m")).select("__row", "m.*")
    keys = every.filter(F.col("kind") == SECRET).select("instance", F.col("kind").alias("known")).distinct()
    graph = every.filter("pattern is not null").select("pattern", "instance", F.when(F.col("kind") >= 0, F.col("kind")).alias("kind"), "fits").distinct()
    graph = graph.join(keys, "instance", "left").select("pattern", "instance", F.coalesce("kind", "known").alias("kind"), "fits").distinct()
    patterns = confident_patterns(graph, rounds, min_support, min_score)
    open_ = every.filter("kind < 0")
    new = open_.select("__row", "start", "end", "fits", "pattern").join(patterns, "pattern").select("__row", "start", "end", "fits", "kind", "score")
    new = new.union(open_.select("__row", "start", "end", "fits", "instance").distinct().join(keys, "instance").select("__row", "start", "end", "fits", F.col("known").alias("kind"), F.lit(1.0).alias("score")))
    new = new.filter(F.col("fits").bitwiseAND(F.expr("shiftleft(1, kind)")) != 0).groupBy("__row", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    new = new.groupBy("__row").agg(F.collect_set(F.struct(F.col("start"), F.col("kind").cast("int").alias("kind"), F.col("end"))).alias("__new"))
    joined = found.drop("__mentions").join(new, "__row", "left")

    def text_of(spans):
        name = F.element_at(F.array(*map(F.lit, ALL_KINDS)), spans["kind"] + 1)
        return F.concat_ws(":", name, spans["start"].cast("string"), spans["end"].cast("string"))

    whole = F.array_sort(F.concat("__base", "__seeds", F.coalesce("__new", F.array().cast(base))))
    secrets = F.size(F.filter(whole, lambda s: s["kind"] == SECRET)).cast("long")
    return joined.select(
        F.col(f"`{id_col}`"), *[F.col(a).alias(c) for a, c in zip(aside, counted, strict=True)], F.array_join(F.transform("__base", text_of), ",").alias("base_spans"),
        F.array_join(F.transform(whole, text_of), ",").alias("spans"), secrets.alias("n_secret"), F.size(whole).cast("long").alias("n_spans"),
    )
