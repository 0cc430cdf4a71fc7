"""Line dedup: sharded cuckoo filters in front of exact reference-count tables."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field as attribute

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import as_bytes, field, join_counted, map_arrow, map_batches, materialize, plain

BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
KEY, DOC = "__line_key", "__line_doc"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key (blanks stripped, A-Z lower-cased); None if the key has
    fewer than ``min_chars`` code points."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """16-bit tags in buckets of four; a tag that finds no place goes to an exact overflow
    table, so the filter never misses an inserted key. Deleting an inserted key undoes it."""

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 0
        self.buckets = 1 << max(1, math.ceil(math.log2(max(1, capacity) / (self.SLOTS * 0.85))))
        self.table = np.zeros((self.buckets, self.SLOTS), np.uint16)
        self.overflow: dict[bytes, int] = {}

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tag and both buckets of 16-byte keys given as rows of two uint64."""
        tags = ((keys[:, 0] >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (keys[:, 1] & np.uint64(self.buckets - 1)).astype(np.int64)
        return tags, first, self._other(first, tags)

    def _other(self, bucket, tag):
        mixed = (np.asarray(tag).astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(self.buckets - 1)
        return (np.asarray(bucket).astype(np.uint64) ^ mixed).astype(np.int64)

    @staticmethod
    def rows(keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)

    def insert(self, keys: list[bytes]) -> None:
        if not keys:
            return
        self.size += len(keys)
        tags, one, two = self._places(self.rows(keys))
        table = self.table
        rng = np.random.default_rng(17)
        for key, tag, a, b in zip(keys, tags.tolist(), one.tolist(), two.tolist(), strict=True):
            path: list[tuple[int, int, int]] = []
            at, moving = a, tag
            for step in range(self.KICKS):
                spots = np.flatnonzero(table[at] == 0)
                if not len(spots) and step == 0:
                    at = b
                    spots = np.flatnonzero(table[at] == 0)
                if len(spots):
                    table[at, spots[0]] = moving
                    break
                slot = int(rng.integers(self.SLOTS))
                path.append((at, slot, int(table[at, slot])))
                table[at, slot], moving = moving, int(table[at, slot])
                at = int(self._other(at, moving))
            else:
                for where, slot, old in reversed(path):  # nothing else may lose its place
                    table[where, slot] = old
                self.overflow[key] = self.overflow.get(key, 0) + 1

    def delete(self, keys: list[bytes]) -> None:
        if not keys:
            return
        tags, one, two = self._places(self.rows(keys))
        for key, tag, a, b in zip(keys, tags.tolist(), one.tolist(), two.tolist(), strict=True):
            if key in self.overflow:
                self.overflow[key] -= 1
                if not self.overflow[key]:
                    del self.overflow[key]
                continue
            for at in (a, b):
                spots = np.flatnonzero(self.table[at] == tag)
                if len(spots):
                    self.table[at, spots[0]] = 0
                    break
            else:
                raise KeyError("the key was never inserted")
        self.size -= len(keys)

    def to_row(self) -> dict:
        """What ``from_row`` makes the filter of again: plain numbers and bytes."""
        extra = b"".join(k * n for k, n in self.overflow.items())
        return {"capacity": self.capacity, "size": self.size, "tags": self.table.tobytes(), "extra": extra}

    @classmethod
    def from_row(cls, capacity: int, size: int, tags: bytes, extra: bytes) -> CuckooFilter:
        made = cls(capacity)
        made.size = size
        made.table = np.frombuffer(tags, np.uint16).reshape(made.table.shape).copy()
        for i in range(0, len(extra), 16):
            made.overflow[extra[i : i + 16]] = made.overflow.get(extra[i : i + 16], 0) + 1
        return made

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        tags, one, two = self._places(self.rows(keys))
        hit = (self.table[one] == tags[:, None]).any(1) | (self.table[two] == tags[:, None]).any(1)
        if self.overflow:
            hit |= np.fromiter((k in self.overflow for k in keys), bool, len(keys))
        return hit


def postings(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(key, document) of every long line, once a row of ``docs``; rows without an id have none."""
    source = plain(docs, id_col, text_col).filter(F.col(f"`{id_col}`").isNotNull())
    schema = T.StructType([field(KEY, T.BinaryType()), T.StructField(DOC, source.schema[id_col].dataType)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            rows: list[int] = []
            for i, text in enumerate(as_bytes(batch.column(1))):
                found = {line_key(line, min_chars) for line in text.split(b"\n")}
                found.discard(None)
                keys += found
                rows += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0).take(pa.array(rows, pa.int64()))], names=[KEY, DOC])

    return map_arrow(source, run, schema)


_FILTER = T.StructType([*[field(n, T.LongType()) for n in ("shard", "shards", "capacity", "size")], field("tags", T.BinaryType()), field("extra", T.BinaryType())])


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64(KEY), F.lit(shards))


def _sized(keys: int) -> int:
    """The capacity that a filter of so many keys gets; there is room for some more."""
    return math.ceil(1.25 * keys) + 64


@dataclass
class LineIndex:
    """Reference counts of line keys: one exact row for each (key, document).

    ``insert`` and ``delete`` give a new index; deleting the documents just inserted leads back
    to what the index said before, if they weren't in it. ``counts`` has the keys that lose lines:
    those in at least ``min_docs`` documents, with the number of documents and the largest id,
    which keeps them. ``filters`` has a cuckoo filter of these keys for each shard of them, in a
    table; ``refresh`` brings such a table up to this index. Filters are made, changed and asked on
    the executors, a shard at a time, whatever their number.

    Rows with a null id hold nothing; null texts have no key; rows that repeat an id are one
    document; an empty table changes nothing.
    """

    table: DataFrame
    id_col: str
    text_col: str
    min_docs: int = 3
    min_chars: int = 20
    keys_per_shard: int = 1 << 18
    _made: dict = attribute(default_factory=dict)

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, keys_per_shard: int = 1 << 18) -> LineIndex:
        return cls(materialize(postings(docs, id_col, text_col, min_chars)), id_col, text_col, min_docs, min_chars, keys_per_shard)

    def _next(self, table: DataFrame) -> LineIndex:
        return LineIndex(materialize(table), self.id_col, self.text_col, self.min_docs, self.min_chars, self.keys_per_shard)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the lines of ``docs``; those of a document that the index has already are added."""
        return self._next(self.table.union(postings(docs, self.id_col, self.text_col, self.min_chars)).distinct())

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents whose ids stand in ``ids``; ids that it hasn't, and nulls, are ignored."""
        gone = ids.select(F.col(f"`{self.id_col}`").alias(DOC)).distinct()
        return self._next(self.table.join(gone, DOC, "left_anti").select(KEY, DOC))

    def counts(self) -> DataFrame:
        """(key, n_docs, keeper), computed once. The count of distinct documents is spread over
        (key, document) first, so a line that a third of all documents hold is no hot key."""
        if "counts" not in self._made:
            agg = self.table.groupBy(KEY).agg(F.count_distinct(DOC).alias("n_docs"), F.max(DOC).alias("keeper"))
            self._made["counts"] = materialize(agg.filter(F.col("n_docs") >= self.min_docs))
        return self._made["counts"]

    def _built(self, keys: DataFrame, shards: int) -> DataFrame:
        def build(part: pa.Table) -> pa.Table:
            own = part.column(KEY).to_pylist()
            made = CuckooFilter(_sized(len(own)))
            made.insert(own)
            return pa.Table.from_pylist([{"shard": part.column("shard")[0].as_py(), "shards": shards, **made.to_row()}], to_arrow_schema(_FILTER))

        return keys.select(KEY, _shard(shards).alias("shard")).groupBy("shard").applyInArrow(build, _FILTER)

    def filters(self) -> DataFrame:
        """(shard, shards, capacity, size, tags, extra): a filter for each shard that has keys, of
        about ``keys_per_shard`` keys, computed once."""
        if "filters" not in self._made:
            shards = max(1, math.ceil(self.counts().count() / self.keys_per_shard))
            self._made["filters"] = materialize(self._built(self.counts(), shards))
        return self._made["filters"]

    def refresh(self, old: LineIndex) -> DataFrame:
        """The filters of ``old`` brought up to this index by inserting and deleting the keys that
        changed; they become this index's. A filter that gets too full grows: it is made anew from
        the exact table. All are if there are more than twice the keys that their shards are for."""
        before = old.filters()
        shards = before.agg(F.max("shards")).first()[0]
        if shards is None or self.counts().count() > 2 * shards * self.keys_per_shard:
            return self.filters()
        now, then = self.counts().select(KEY), old.counts().select(KEY)
        changes = now.join(then, KEY, "left_anti").withColumn("put", F.lit(True)).union(then.join(now, KEY, "left_anti").withColumn("put", F.lit(False)))
        changes = materialize(changes.withColumn("shard", _shard(shards)))
        added = changes.groupBy("shard").agg(F.sum(F.col("put").cast("long")).alias("added"))
        full = added.join(before, "shard", "left").filter(F.col("capacity").isNull() | (F.col("size") + F.col("added") > F.col("capacity"))).select("shard")
        full = materialize(full)

        def update(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = left.select(["capacity", "size", "tags", "extra"]).to_pylist()
            if not rows:
                return to_arrow_schema(_FILTER).empty_table()
            made = CuckooFilter.from_row(**rows[0])
            put = right.column("put").to_pylist()
            keys = right.column(KEY).to_pylist()
            made.insert([k for k, p in zip(keys, put, strict=True) if p])
            made.delete([k for k, p in zip(keys, put, strict=True) if not p])
            return pa.Table.from_pylist([{"shard": left.column("shard")[0].as_py(), "shards": shards, **made.to_row()}], to_arrow_schema(_FILTER))

        kept = before.join(full, "shard", "left_anti").select(*before.columns)
        updated = kept.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(update, _FILTER)
        grown = self._built(now.withColumn("shard", _shard(shards)).join(full, "shard", "left_semi"), shards)
        self._made["filters"] = materialize(updated.union(grown))
        return self._made["filters"]

    def possible(self, hits: DataFrame, salt_rows: int = 1 << 20) -> DataFrame:
        """The (key, document) rows of ``hits``, a table, whose key its shard's filter may have.

        Rows meet their filter shard by shard: the filter comes first in a partition, its rows
        stream by. A shard of more than ``salt_rows`` rows, for its even part of all rows and for
        those of its repeated keys, as of a line that a third of all documents hold, is spread over
        several copies of its filter. What is broadcast is a number for each shard: 16 bytes for
        ``keys_per_shard`` keys.
        """
        filters = self.filters()
        shards = filters.agg(F.max("shards")).first()[0]
        if shards is None:
            return hits.limit(0)
        even = hits.count() / shards
        load = self.counts().groupBy(_shard(shards).alias("shard")).agg((F.floor((F.sum("n_docs") + even) / salt_rows) + 1).alias("copies"))
        empty = lambda kind: F.lit(None).cast(kind)
        doc = hits.schema[DOC].dataType
        asked = hits.withColumn("shard", _shard(shards)).join(F.broadcast(load), "shard")
        asked = asked.select("shard", F.pmod(F.xxhash64(DOC), F.col("copies")).alias("salt"), F.lit(1).alias("kind"), KEY, DOC, empty("long").alias("capacity"), empty("long").alias("size"), empty("binary").alias("tags"), empty("binary").alias("extra"))
        sent = filters.join(F.broadcast(load), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        sent = sent.select("shard", "salt", F.lit(0).alias("kind"), empty("binary").alias(KEY), empty(doc).alias(DOC), "capacity", "size", "tags", "extra")
        dealt = sent.union(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current: CuckooFilter | None = None
            for batch in batches:
                keys = batch.column(3)
                starts = np.flatnonzero(np.asarray(batch.column(2)) == 0).tolist()
                edges = [0, *starts, batch.num_rows]
                for a, b in zip(edges, edges[1:]):  # noqa: B905
                    if a in starts:
                        row = batch.slice(a, 1).select(["capacity", "size", "tags", "extra"]).to_pylist()[0]
                        current = CuckooFilter.from_row(**row)
                        a += 1
                    if a < b:
                        part = batch.select([KEY, DOC]).slice(a, b - a)
                        yield part.filter(pa.array(current.contains(keys.slice(a, b - a).to_pylist())))

        return map_arrow(dealt, run, hits.schema)

    def dropped(self, docs: DataFrame | None = None) -> DataFrame:
        """(document, set of the keys it loses), of ``docs`` or of the documents of this index. The
        filters keep keys that nothing drops away from the exact table."""
        hits = self.table if docs is None else materialize(postings(docs, self.id_col, self.text_col, self.min_chars))
        exact = self.counts().select(KEY, F.col("n_docs").alias("__n"), "keeper")
        found = join_counted(self.possible(hits), exact, KEY, hits.count()).filter(F.col(DOC) != F.col("keeper"))
        return found.groupBy(DOC).agg(F.collect_set(KEY).alias("__line_drops"))


def drop_lines(text: bytes, drops: list[bytes] | None, min_chars: int) -> tuple[int, int, bytes]:
    lines = text.split(b"\n")
    if not drops:
        return len(lines), 0, text
    gone = set(drops)
    kept = [line for line in lines if line_key(line, min_chars) not in gone]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, index: LineIndex | None = None
) -> DataFrame:
    """Every row of ``docs`` with its repeated lines gone, plus n_lines and n_dropped.

    Lines end at ``\\n``. A key (blanks stripped, A-Z lower-cased) of ``min_chars`` code points or
    more that at least ``min_docs`` documents hold loses all its lines but those of the largest
    id that holds it. ``index``: reference counts to judge by; by default those of ``docs``.

    A null text counts as one empty line and comes back empty. Rows with a null id hold nothing
    and lose nothing. Rows that repeat an id are one document and lose the same keys. All columns
    pass through; a column called n_lines or n_dropped gives way to the result. An empty table
    gives none. Texts are read once for their keys; only hashes and ids are shuffled to find those
    that go, then each document meets its own set of dropped keys; no task gathers the documents
    of a line.
    """
    own = LineIndex.build(docs, id_col, text_col, min_docs, min_chars) if index is None else None
    drops = own.dropped() if own else index.dropped(docs)
    index = own or index
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = plain(docs, *kept).join(drops, F.col(f"`{id_col}`") == F.col(DOC), "left").drop(DOC)
    chars = index.min_chars

    def make():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            at = batch.schema.get_field_index
            rows = [drop_lines(t, d, chars) for t, d in zip(as_bytes(batch.column(at(text_col))), batch.column(at("__line_drops")).to_pylist(), strict=True)]
            return [pa.array([r[2] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]

        return run

    added = [field("__line_text", T.StringType()), field("n_lines", T.LongType()), field("n_dropped", T.LongType())]
    out = map_batches(joined, added, make, [c for c in kept if c != text_col])
    return out.select(*[F.col("__line_text").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in kept], "n_lines", "n_dropped")
