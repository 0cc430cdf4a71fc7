"""Benchmark decontamination: an FM-index for each shard of training text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from .common import WORD_BYTES, as_bytes, field, map_arrow, map_batches, materialize, plain, words_of


def suffix_array(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes. 0 is a separator, smaller than any word; of two separators the one
    that stands first is smaller, so no two suffixes are equal. Prefix doubling, begun with as
    many symbols as fit a 64-bit key and carried on only where suffixes still tie."""
    n = len(symbols)
    h = 62 // bits
    key = symbols.astype(np.int64)
    alive = symbols > 0
    for t in range(1, h):
        shifted = np.zeros(n, np.int64)
        shifted[: max(0, n - t)] = symbols[t:]
        key = (key << bits) | np.where(alive, shifted, 0)
        alive = alive & (shifted > 0)
    order = np.argsort(key, kind="stable")
    in_order = key[order]
    tied = np.zeros(n, bool)
    same = (in_order[1:] == in_order[:-1]) & alive[order[1:]]
    tied[1:] |= same
    tied[:-1] |= same
    head = np.ones(n, bool)
    head[1:] = ~same
    slots = np.flatnonzero(tied)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while len(slots):
        at = order[slots]
        one, two = rank[at], rank[at + h]
        by = np.lexsort((two, one))
        at, one, two = at[by], one[by], two[by]
        order[slots] = at
        same = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        head = np.append(True, ~same)
        rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
        tied = np.append(same, False) | np.append(False, same)
        slots = slots[tied]
        h *= 2
    return order


class BitRank:
    """A bit array in 64-bit words with a running count before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class FMIndex:
    """Burrows-Wheeler text in a wavelet tree (level by level), with sampled suffix positions.

    ``symbols`` holds words from 1 and separators 0, and ends with a separator. Sampled are the
    first word after each separator and every ``sample``-th position, so a walk back from any
    word meets a sample before it would cross a separator.
    """

    def __init__(self, symbols: np.ndarray, vocabulary: int, sample: int = 8):
        n = len(symbols)
        self.n, self.bits = n, max(1, int(vocabulary).bit_length())
        order = suffix_array(symbols, self.bits)
        before = np.roll(symbols, 1)
        row = before[order]
        counts = np.bincount(symbols, minlength=vocabulary + 2)
        self.start = np.concatenate([[0], np.cumsum(counts)])
        self.levels: list[tuple[BitRank, int]] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            self.levels.append((BitRank(bit), int(n - bit.sum())))
            row = np.concatenate([row[~bit], row[bit]])
        self.base = self._down(np.arange(vocabulary + 1), np.zeros(vocabulary + 1, np.int64))
        marked = (before == 0) | (np.arange(n) % sample == 0)
        self.marks = BitRank(marked[order])
        self.positions = order[marked[order]]

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(i)
            i = np.where(symbol >> (self.bits - 1 - level) & 1, zeros + ones, i - ones)
        return i

    def _step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """First row of the suffixes that begin with the symbol and go on like row i or later."""
        return self.start[symbol] + self._down(symbol, i) - self.base[symbol]

    def _back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix one position earlier."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros in self.levels:
            bit = bits.get(i)
            ones = bits.rank(i)
            i = np.where(bit, zeros + ones, i - ones)
            symbol = symbol * 2 + bit
        return self.start[symbol] + i - self.base[symbol]

    def count(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [from, to) whose suffixes begin with each phrase; phrases are rows of equal length."""
        last = phrases[:, -1]
        low, high = self.start[last].copy(), self.start[last + 1].copy()
        left = np.flatnonzero(low < high)
        for t in range(phrases.shape[1] - 2, -1, -1):
            if not len(left):
                break
            symbol = phrases[left, t]
            low[left], high[left] = self._step(symbol, low[left]), self._step(symbol, high[left])
            left = left[low[left] < high[left]]
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows."""
        out = np.empty(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            here = self.marks.get(at)
            out[left[here]] = self.positions[self.marks.rank(at[here])] + steps
            left, at = left[~here], at[~here]
            if len(at):
                at = self._back(at)
            steps += 1
        return out


@dataclass
class Phrases:
    """Distinct windows of benchmark items, as word numbers, and the items each belongs to."""

    vocabulary: dict[bytes, int]
    by_size: dict[int, np.ndarray]
    items: dict[int, list[list[int]]]
    names: list[str | None]

    @classmethod
    def of(cls, rows: Iterable[tuple[object, str | None]], window: int) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        names: dict[str | None, int] = {}
        for name, text in rows:
            words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of((text or "").encode())]
            item = names.setdefault(None if name is None else str(name), len(names))
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                found.setdefault(tuple(words[i : i + size]), set()).add(item)
        sizes = sorted({len(p) for p in found})
        kept = {s: [p for p in found if len(p) == s] for s in sizes}
        return cls(vocabulary, {s: np.array(p, np.int64) for s, p in kept.items()}, {s: [sorted(found[x]) for x in p] for s, p in kept.items()}, list(names))


_SPAN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])
_FOUND = [field("__words", T.LongType()), field("__spans", T.ArrayType(_SPAN)), field("__items", T.ArrayType(T.StringType()))]


def search_shard(texts: list[list[int]], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each text (as word numbers, 0 for words no phrase has): how many words are hit, the
    merged spans [first, end) of hit words, and the items found.

    Words that no phrase has part the text like its end does, and a run of words shorter than
    every phrase can't hold one; the index is built over all other runs.
    """
    sizes = [len(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
    whole = np.zeros(int(starts[-1]) + 1, np.int32)
    for begin, text in zip(starts.tolist(), texts):  # noqa: B905
        whole[begin : begin + len(text)] = text
    none = [(0, [], [])] * len(texts)
    if not phrases.by_size:
        return none
    inside = np.concatenate([[0], (whole > 0).view(np.int8), [0]])
    edge = np.diff(inside)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - first >= min(phrases.by_size)
    first, end = first[long], end[long]
    if not len(first):
        return none
    length = end - first + 1  # each run and the separator behind it
    origin = np.arange(int(length.sum())) + np.repeat(first - (np.cumsum(length) - length), length)
    index = FMIndex(whole[origin], len(phrases.vocabulary))
    change = np.zeros(len(whole) + 1, np.int64)
    met: list[set[int]] = [set() for _ in texts]
    for size, table in phrases.by_size.items():
        low, high = index.count(table)
        hit = np.flatnonzero(high > low)
        times = (high - low)[hit]
        rows = np.arange(int(times.sum())) + np.repeat(low[hit] - (np.cumsum(times) - times), times)
        at = origin[index.locate(rows)]
        np.add.at(change, at, 1)
        np.add.at(change, at + size, -1)
        text = np.searchsorted(starts, at, "right") - 1
        for pair in np.unique(text * len(table) + np.repeat(hit, times)).tolist():
            met[pair // len(table)].update(phrases.items[size][pair % len(table)])
    hit = np.cumsum(change[:-1]) > 0
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(starts, first, "right") - 1
    out = none.copy()
    for o in np.unique(owner).tolist():
        own = owner == o
        spans = [(int(a - starts[o]), int(b - starts[o])) for a, b in zip(first[own], end[own], strict=True)]
        out[o] = (sum(b - a for a, b in spans), spans, sorted(met[o]))
    return out


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of these spans and what stands between them; what is left on
    the two sides of a cut stays apart by a newline."""
    if not spans:
        return text
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_BYTES))]
    out, at = [], 0
    for first, end in spans:
        out.append(text[at : places[first][0]].rstrip())
        at = places[end - 1][1]
    out.append(text[at:].lstrip())
    return b"\n".join(out)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> tuple[int, Iterator[Phrases]]:
    """How many blocks of about ``block_bytes`` of benchmark text there are, and their phrases, one
    block at a time on the driver."""
    source = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).filter("t is not null").distinct()
    size = source.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    block = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    return n, (Phrases.of([(r["i"], r["t"]) for r in source.filter(block == k).orderBy("i", "t").toLocalIterator()], window) for k in range(n))


def _search(docs: DataFrame, phrases: Phrases, text_col: str, keep: list[str], shard_words: int) -> DataFrame:
    """``keep`` and __words, __spans and __items for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)
    schema = T.StructType([docs.schema[c] for c in keep] + _FOUND)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, known = to_arrow_schema(schema), sent.value
        number = known.vocabulary.get
        waiting: list[pa.RecordBatch] = []  # a shard goes on over batches until it has enough words
        shard: list[list[int]] = []
        sizes: list[int] = []
        found: list[tuple[int, list[tuple[int, int]], list[int]]] = []
        held = 0

        def out(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            own, counts = found[:n], sizes[:n]
            del found[:n], sizes[:n]
            spans = pa.array([[{"first": a, "end": b} for a, b in f[1]] for f in own], arrow.field("__spans").type)
            items = pa.array([[known.names[k] for k in f[2] if known.names[k] is not None] for f in own], pa.list_(pa.string()))
            old = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip([*old, pa.array(counts, pa.int64()), spans, items], arrow, strict=True)], schema=arrow)

        for batch in batches:
            waiting.append(batch)
            for text in as_bytes(batch.column(batch.schema.get_field_index(text_col))):
                shard.append([number(w, 0) for w in words_of(text)])
                sizes.append(len(shard[-1]))
                held += sizes[-1]
                if held >= shard_words:
                    found += search_shard(shard, known)
                    shard, held = [], 0
            while waiting and len(found) >= waiting[0].num_rows:
                yield out(waiting.pop(0))
        found += search_shard(shard, known)
        for batch in waiting:
            yield out(batch)

    return map_arrow(plain(docs, *dict.fromkeys([*keep, text_col])), run, schema)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 10, shard_words: int = 1 << 20, block_bytes: int = 4 << 20, keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` (default: the id), n_words, n_hit, spans ([first, end) in words, merged) and items
    (ids found, sorted) of every row of ``docs``.

    A window is ``window`` consecutive words of an item, or a shorter item as a whole; a word is
    hit if it lies in an occurrence of any window. Words: ``[0-9a-z]`` and all beyond ASCII,
    after lower-casing A-Z. Each ``shard_words`` words of a task get an FM-index, in which all
    windows are searched backward at once and located.

    Null texts and items have no words; a null item id marks words but is no item; an item's
    repeated rows count once. Null ids and repeated documents stay; an empty benchmark hits
    nothing; an empty table gives none. The benchmark reaches executors in blocks of about
    ``block_bytes`` of text, one after another; what they find in a text, only for texts with a
    hit, is merged by a hash of the text.
    """
    keep = [id_col] if keep is None else keep
    n, blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    if n == 1:
        found = _search(docs, next(blocks), text_col, keep, shard_words)
    else:
        key = "__text_key"
        keyed = docs.withColumn(key, F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))
        hits: DataFrame | None = None
        for block in blocks:  # what a block finds waits in the shared folder; most texts have no hit
            part = materialize(_search(keyed, block, text_col, [key], shard_words).filter(F.size("__spans") > 0).drop("__words"))
            hits = part if hits is None else hits.union(part)
        once = hits.distinct().groupBy(key).agg(F.flatten(F.collect_list("__spans")).alias("__spans"), F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__items"))
        joined = keyed.join(once, key, "left")

        def merged(batch: pa.RecordBatch) -> list[pa.Array]:
            at = batch.schema.get_field_index
            spans = [merge_spans([(s["first"], s["end"]) for s in x or ()]) for x in batch.column(at("__spans")).to_pylist()]
            words = pa.array([len(words_of(t)) for t in as_bytes(batch.column(at(text_col)))], pa.int64())
            return [words, pa.array([[{"first": a, "end": b} for a, b in x] for x in spans], to_arrow_type(_FOUND[1].dataType)), pa.array([x or [] for x in batch.column(at("__items")).to_pylist()], pa.list_(pa.string()))]

        found = map_batches(joined, _FOUND, lambda: merged, keep)
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(*[F.col(f"`{c}`") for c in keep], F.col("__words").alias("n_words"), hit.alias("n_hit"), F.col("__spans").alias("spans"), F.array_sort("__items").alias("items"))


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10
) -> DataFrame:
    """``docs`` with the merged spans of benchmark windows cut out of the texts. A document of
    which no word is left goes; one without a hit stays as it is, with or without words, so null and
    empty texts stay. Rows that repeat are treated alike; an empty table stays empty."""
    clash = {c: f"__own_{c}" for c in docs.columns if c in ("n_words", "n_hit", "spans", "items")}
    aside = docs.withColumnsRenamed(clash)
    found = find_contamination(aside, benchmark, id_col, text_col, item_col, item_text_col, window, keep=aside.columns)
    left = found.filter((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    schema = aside.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            column, spans = batch.column(at(text_col)), batch.column(at("spans")).to_pylist()
            texts = [t if not s else cut_words(t, [(x["first"], x["end"]) for x in s]) for t, s in zip(column.cast(pa.binary()).to_pylist(), spans, strict=True)]
            out = batch.select(schema.names)
            yield out.set_column(out.schema.get_field_index(text_col), out.schema.field(text_col), pa.array(texts, pa.binary()).cast(column.type))

    return map_arrow(left, run, schema).select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])

