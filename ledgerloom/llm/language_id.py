"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, field, map_arrow, map_batches, plain

UNKNOWN = "und"
#: Number of n-gram features. Trigrams of bytes are hashed to them.
FEATURES = 1 << 16
#: ASCII letters in lower case and all other UTF-8 bytes stay; the rest parts words.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_CHUNK = 1 << 16


def features(text: bytes) -> np.ndarray:
    """A feature for each byte trigram of a whole text's words; none if the text has no letter."""
    words = text.translate(_LETTERS).split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" " + b" ".join(words) + b" "
    if not any(0x61 <= b <= 0x7A for b in words[0]) and not any(c.isalpha() for c in text.decode("utf-8", "replace")):
        return np.zeros(0, np.int64)
    b = np.frombuffer(joined, np.uint8).astype(np.uint32)
    return (((b[:-2] * 40503 + b[1:-1]) * 40503 + b[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


def codebook(classes: int, seed: int = 7) -> np.ndarray:
    """Codewords of +1 and -1, one row for each class. Up to seven classes: every split into two
    sides. More: of many seeded random codes, the one whose closest codewords differ most."""
    if classes <= 1:
        return np.ones((classes, 1), np.int8)
    if classes <= 7:
        splits = range(1, 1 << (classes - 1))
        return np.array([[1 if s >> c & 1 else -1 for s in splits] for c in range(classes)], np.int8)
    bits = 2 * int(np.ceil(10 * np.log2(classes))) // 2
    rng = np.random.default_rng(seed)
    best, found = -1, None
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, bits))
        code = code[:, (code == 1).any(0) & (code == -1).any(0)]
        apart = (code[:, None, :] != code[None, :, :]).sum(2) + np.eye(classes, dtype=int) * bits
        if apart.min() > best:
            best, found = apart.min(), code
    return found


@dataclass
class LanguageModel:
    """Languages, their codewords, a linear n-gram classifier for each bit, and the weight that a
    bit has in the distance to a language's codeword."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    steep: float = 4.0
    sharp: float = 8.0

    @classmethod
    def fit(cls, languages: list[str], counts: np.ndarray, smooth: float = 0.5) -> LanguageModel:
        """``counts``: how often each language has each feature. A bit's classifier is the log
        ratio of the mean feature frequencies on its two sides; the trust in it for a language
        is how far training text of that language comes out on the right side."""
        code = codebook(len(languages))
        if not languages:
            return cls([], code, np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1)))
        freq = (counts + smooth) / (counts.sum(1, keepdims=True) + smooth * counts.shape[1])
        sides = []
        for bit in code.T:
            plus = freq[bit == 1].mean(0) if (bit == 1).any() else np.ones(counts.shape[1])
            minus = freq[bit == -1].mean(0) if (bit == -1).any() else plus
            sides.append(np.log(plus) - np.log(minus))
        weights = np.array(sides).T
        seen = counts / np.maximum(1, counts.sum(1, keepdims=True))
        trust = np.clip(code * (seen @ weights), 1e-6, None)
        return cls(languages, code, np.ascontiguousarray(weights, np.float32), trust / trust.sum(1, keepdims=True))

    def margins(self, text: bytes) -> np.ndarray | None:
        """Mean output of each bit's classifier over all n-grams; None without a letter."""
        found = features(text)
        if not len(found):
            return None
        total = np.zeros(self.weights.shape[1])
        for i in range(0, len(found), _CHUNK):
            total += self.weights[found[i : i + _CHUNK]].sum(0, dtype=np.float64)
        return total / len(found)

    def predict(self, text: bytes, min_gap: float = 0.05) -> tuple[str, float, bool]:
        """(language, score, ambiguous). The language is the one whose codeword is nearest by the
        weighted logistic loss of the margins; the score is its share of exp(-distance)."""
        margins = self.margins(text) if self.languages else None
        if margins is None:
            return UNKNOWN, 0.0, True
        loss = np.logaddexp(0.0, -self.steep * self.code * margins)
        distance = (self.trust * loss).sum(1)
        share = np.exp(-self.sharp * (distance - distance.min()))
        share /= share.sum()
        order = np.argsort(distance, kind="stable")
        gap = share[order[0]] - share[order[1]] if len(order) > 1 else 1.0
        return self.languages[order[0]], float(share[order[0]]), bool(gap < min_gap)


def remainder(id_col: str, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(folds))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 1, per_language: int = 3000, max_languages: int = 256) -> LanguageModel:
    """Learn from rows with a text, a language and an id whose crc32 modulo 3 isn't ``held_out``.

    The sample is bounded: of each of the ``max_languages`` languages with most rows (of equal ones
    the first by name) about ``per_language`` rows, chosen by a hash of the id, with whole texts.
    Executors count features by language; the driver gets only the counts. Rows that repeat count
    each; without a usable row the model knows no language.
    """
    usable = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{lang_col}`").cast("string").alias("__lang"))
    usable = usable.filter(F.col(f"`{text_col}`").isNotNull() & F.col("__lang").isNotNull() & (remainder(id_col) != held_out))
    sizes = {r["__lang"]: r["count"] for r in usable.groupBy("__lang").count().orderBy(F.desc("count"), "__lang").limit(max_languages).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel.fit([], np.zeros((0, FEATURES)))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])
    drawn = F.col("__lang").isin(languages) & (F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(1_000_000)) < share[F.col("__lang")] * 1_000_000)
    sample = usable.filter(drawn).select(F.col(f"`{text_col}`").alias("__text"), "__lang")
    place = {lang: i for i, lang in enumerate(languages)}
    schema = T.StructType([field("lang", T.IntegerType()), field("feature", T.IntegerType()), field("times", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                own = counts.setdefault(place[lang], np.zeros(FEATURES, np.int64))
                own += np.bincount(features(text), minlength=FEATURES)
        for lang, own in counts.items():
            some = np.flatnonzero(own)
            arrays = [np.full(len(some), lang, np.int32), some.astype(np.int32), own[some]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=schema.names)

    counts = np.zeros((len(languages), FEATURES))
    found = map_arrow(sample, run, schema).groupBy("lang", "feature").agg(F.sum("times").alias("times")).toArrow()
    counts[found.column(0).to_numpy(), found.column(1).to_numpy()] = found.column(2).to_numpy()
    return LanguageModel.fit(languages, counts)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """lang_pred, score (0 to 1) and ambiguous for every whole text, behind the columns ``keep``
    (default: the id alone).

    Only the text is an input of the prediction. ``und`` with score 0 where the text is null or
    has no letter, or where the model knows no language. Null ids and repeated rows stay; an
    empty table gives none. The model's size is languages times features, whatever the data's.
    """
    keep = [id_col] if keep is None else [c for c in keep if c not in ("lang_pred", "score", "ambiguous")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [own.predict(t) for t in as_bytes(batch.column(batch.schema.get_field_index(text_col)))]
            return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]

        return run

    added = [field("lang_pred", T.StringType()), field("score", T.DoubleType()), field("ambiguous", T.BooleanType())]
    return map_batches(plain(docs, *dict.fromkeys([*keep, text_col])), added, make, keep)


def keep_identified(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the texts whose language can't be told: null texts and texts without a
    letter. Ambiguity alone doesn't reject a document."""
    clash = {c: f"__own_{c}" for c in docs.columns if c in ("lang_pred", "score", "ambiguous")}
    aside = docs.withColumnsRenamed(clash)
    found = identify(aside, model, id_col, text_col, aside.columns).filter(F.col("lang_pred") != UNKNOWN)
    return found.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])
