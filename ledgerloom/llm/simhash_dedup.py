"""SimHash near-dedup: a self-join of binary tries, then connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, field, join_counted, map_arrow, map_batches, materialize, plain, release

SEED = 42
_CHUNK = 1 << 15


def fingerprint(text: bytes, size: int = 4) -> int:
    """SimHash of the ``size``-word shingles: words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z,
    repeats included, each hashed by XXH64 with seed 42. Fewer words: the whole sequence is the
    one shingle. No word: 0. A bit is 1 if over half of the hashes set it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    n = len(words) - size + 1
    for i in range(0, n, _CHUNK):
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[i : min(n, i + _CHUNK)], ends[i + size - 1 :])], "<u8")  # noqa: B905
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(counts * 2 > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, out: str = "fp", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns ``keep`` and ``out`` (the fingerprint's bits as a signed long) of every row."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = as_bytes(batch.column(batch.schema.get_field_index(text_col)))
        return [pa.array(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))]

    return map_batches(plain(docs, id_col, *keep, text_col), [field(out, T.LongType())], lambda: run, [id_col, *keep])


# -- the trie join ------------------------------------------------------------


def _levels(keys: np.ndarray, cell: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Binary tries over ``keys``, sorted within ``cell``: for each depth the nodes' first leaf,
    end, first child and number of children. Depth 0 has one root for each cell."""
    n = len(keys)
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = cell[1:] != cell[:-1]
    starts = np.flatnonzero(new)
    levels = []
    for depth in range(64):
        prefix = keys >> np.uint64(63 - depth)
        below = new.copy()
        below[1:] |= prefix[1:] != prefix[:-1]
        children = np.flatnonzero(below)
        first = np.searchsorted(children, starts)
        levels.append((starts, np.append(starts[1:], n), first, np.diff(np.append(first, len(children)))))
        starts = children
    return levels


def trie_self_join(keys: np.ndarray, cell: np.ndarray, side: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of leaves in one cell that differ in at most ``errors`` bits, where
    ``side`` says with which leaves of its cell a leaf is compared: 0 with all, 1 with those of
    side 2 only and the other way round (a cell of two slices).

    Both tries are traversed together: a pair of nodes holds the bits in which the paths to them
    differ; its children's pairs add one bit at most; beyond ``errors`` the pair is pruned. Pairs
    of single leaves are finished at once, over the bits that remain.
    """
    order = np.lexsort((keys, cell))
    keys, cell, side = keys[order], cell[order], side[order]
    left, right = [], []
    levels = _levels(keys, cell) if len(keys) else []
    a = b = np.arange(len(levels[0][0]) if levels else 0)
    spent = np.zeros(len(a), np.int8)
    for depth, (starts, ends, first, width) in enumerate(levels):
        alone = (ends[a] - starts[a] == 1) & (ends[b] - starts[b] == 1)
        if alone.any():
            i, j = starts[a[alone]], starts[b[alone]]
            near = (np.bitwise_count(keys[i] ^ keys[j]) <= errors) & (i != j)
            left.append(i[near])
            right.append(j[near])
            a, b, spent = a[~alone], b[~alone], spent[~alone]
        if not len(a):
            break
        pairs = width[a] * width[b]
        at = np.repeat(np.arange(len(a)), pairs)
        k = np.arange(len(at)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        wide = width[b][at]
        ca, cb = first[a[at]] + k // wide, first[b[at]] + k % wide
        children = np.append(levels[depth + 1][0], len(keys)) if depth < 63 else np.arange(len(keys) + 1)
        bit = np.uint64(63 - depth)
        cost = spent[at] + (((keys[children[ca]] ^ keys[children[cb]]) >> bit) & np.uint64(1)).astype(np.int8)
        keep = (cost <= errors) & (ca <= cb)
        a, b, spent = ca[keep], cb[keep], cost[keep]
        if depth == 63:
            # equal keys are one leaf here; tries hold distinct keys, so a pair of leaves is left
            left.append(a[a != b])
            right.append(b[a != b])
    i = np.concatenate(left) if left else np.zeros(0, np.int64)
    j = np.concatenate(right) if right else np.zeros(0, np.int64)
    ok = (side[i] == 0) | (side[i] != side[j])
    return order[i[ok]], order[j[ok]]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected to."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        while (jump := label[label] != label).any():
            label[jump] = label[label[jump]]
        if (label == before).all():
            break
    return label


def _fields(value: Column, width: int, chosen: Sequence[int], parts: int) -> Column:
    """The bits of the ``chosen`` of ``parts`` blocks of the lowest ``width`` bits, side by side."""
    bounds = [width * k // parts for k in range(parts + 1)]
    out = F.lit(0).cast("long")
    for k in chosen:
        size = bounds[k + 1] - bounds[k]
        block = F.shiftrightunsigned(value, width - bounds[k + 1]).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
        out = F.shiftleft(out, size).bitwiseOR(block)
    return out


def blocks_for(rows: int, errors: int, slice_rows: int) -> int:
    """Into how many blocks fingerprints are cut: as few as give buckets of about ``slice_rows`` or
    less on average. More blocks mean wider keys, and more of them."""
    parts = errors + 1
    while parts < errors + 4 and rows >> (64 * (parts - errors) // parts) > slice_rows:
        parts += 1
    return parts


def cells(distinct: DataFrame, errors: int = 4, slice_rows: int = 1024) -> DataFrame:
    """(fp, bucket, cell, side): what has to be compared. Two fingerprints that differ in at most
    ``errors`` bits meet in a cell at least once; see ``trie_self_join`` for side.

    Cut into ``parts`` blocks of bits, they agree in ``parts - errors`` of these; each choice of so
    many blocks is a key. The number of blocks follows that of the fingerprints, so the mean
    bucket stays small. In a bucket that is crowded all the same, the bits outside its key are cut
    again, into ``errors + 2`` blocks of which two agree, so its rows go on to narrower buckets, a
    fixed number each. Only what is crowded then too is cut into slices by hash, and each pair of
    slices is a cell of its own: no task holds a whole hot bucket and no pair is lost.
    """
    parts = blocks_for(distinct.count(), errors, slice_rows)
    keys = list(combinations(range(parts), parts - errors))
    value = [_fields(F.col("fp"), 64, k, parts) * len(keys) + i for i, k in enumerate(keys)]
    placed = distinct.select("fp", F.explode(F.array(*value)).alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = placed.join(sizes, "bucket").select("fp", "bucket", "n")
    none = F.lit(0).cast("long")
    calm = shared.filter(F.col("n") <= slice_rows).select("fp", "bucket", none.alias("cell"), F.lit(0).alias("side"))

    which = F.pmod("bucket", F.lit(len(keys)))
    rest = F.lit(None).cast("long")
    for i, k in enumerate(keys):
        rest = F.when(which == i, _fields(F.col("fp"), 64, [b for b in range(parts) if b not in k], parts)).otherwise(rest)
    width = 64 - min(sum(64 * (b + 1) // parts - 64 * b // parts for b in k) for k in keys)
    narrow = [F.xxhash64("bucket", F.lit(i), _fields(F.col("rest"), width, k, errors + 2)) for i, k in enumerate(combinations(range(errors + 2), 2))]
    again = shared.filter(F.col("n") > slice_rows).withColumn("rest", rest).select("fp", F.explode(F.array(*narrow)).alias("bucket"))
    again = again.distinct()
    sizes = again.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cut = F.ceil(F.col("n") / slice_rows).cast("long")
    sliced = again.join(sizes, "bucket").select("fp", "bucket", cut.alias("n")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")))
    other = F.explode(F.sequence(none, F.col("n") - 1))
    pairs = sliced.withColumn("other", other).select("fp", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")
    side = F.when(F.col("lo") == F.col("hi"), 0).when(F.col("own") == F.col("lo"), 1).otherwise(2)
    return calm.union(pairs.select("fp", "bucket", F.xxhash64("lo", "hi").alias("cell"), side.alias("side")))


def linked(distinct: DataFrame, errors: int = 4, slice_rows: int = 1024, chunk_pairs: int = 1 << 20) -> DataFrame:
    """(a, b): fingerprints in one component; the links of every pair within ``errors`` bits are kept.

    Within each of the ``cells`` the tries are joined; of its links a star for each component goes
    on, at most one row a fingerprint.
    """
    dealt = cells(distinct, errors, slice_rows).select("fp", "bucket", "cell", F.col("side").cast("int").alias("side"))
    dealt = dealt.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: list[np.ndarray]) -> pa.RecordBatch:
            fp, bucket, cell, side = table
            _, whole = np.unique(np.stack([bucket, cell]), axis=1, return_inverse=True)
            i, j = trie_self_join(fp.view(np.uint64), whole.reshape(-1), side, errors)
            label = forest(len(fp), i, j)
            far = np.flatnonzero(label != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[label[far]])], names=["a", "b"])

        def cut(table: list[np.ndarray], last: bool) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
            """(cells to join, what is left), a bounded number of pairs at a time; the last cell may go on."""
            edges = np.append(0, np.flatnonzero((table[1][1:] != table[1][:-1]) | (table[2][1:] != table[2][:-1])) + 1)
            if last:
                edges = np.append(edges, len(table[2]))
            work = np.cumsum(np.diff(edges).astype(np.int64) ** 2)
            begin, spent = 0, 0
            for k in range(len(work)):
                if work[k] - spent > chunk_pairs or k == len(work) - 1:
                    yield [c[edges[begin] : edges[k + 1]] for c in table], [c[edges[k + 1] :] for c in table]
                    begin, spent = k + 1, work[k]

        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(h[0]) for h in held) >= 1 << 16:
                table = [np.concatenate(c) for c in zip(*held, strict=True)]
                held = [table]
                for cells, left in cut(table, False):
                    yield out(cells)
                    held = [left]
        if held:
            for cells, _ in cut([np.concatenate(c) for c in zip(*held, strict=True)], True):
                yield out(cells)

    schema = T.StructType([field("a", T.LongType()), field("b", T.LongType())])
    return map_arrow(dealt, run, schema)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link: large-star and small-star rounds until nothing
    changes. Each round is written to the shared folder and takes the place of the one before; a
    node's links are never gathered, only their minimum is."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges = materialize(edges)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while before[0]:
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(low, "x").filter("y <> m").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(low, "v")
        small = joined.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u")))
        old, edges = edges, materialize(small.distinct())
        release(old)
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _grouped(table: DataFrame, fp: str, least: Column, errors: int) -> DataFrame:
    """(fp, __n, __first) of each fingerprint: its rows, and the least ``least`` of its component."""
    nodes = materialize(table.groupBy(fp).agg(F.count(F.lit(1)).alias("__n"), F.min(least).alias("__least")))
    roots = components(linked(nodes.select(F.col(fp).alias("fp")), errors))
    rooted = nodes.join(roots, nodes[fp] == roots["node"], "left").select(fp, "__n", "__least", F.coalesce("root", fp).alias("__root"))
    firsts = rooted.groupBy("__root").agg(F.min("__least").alias("__first"))
    return rooted.join(firsts, "__root").select(fp, "__n", "__first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, errors: int = 4) -> DataFrame:
    """The id, fingerprint (16 lowercase hex digits) and component_id of every row of ``docs``.

    Documents whose SimHash fingerprints differ in ``errors`` bits or fewer are linked;
    component_id is the smallest id reachable over links, a row's own included.

    Null and empty texts have the fingerprint zero and are linked like any other. A row with a
    null id has a component, but its id is nobody's component_id (null if no other has one).
    Rows that repeat an id or a text give repeated results. An empty table gives none; other
    columns are not read. Equal fingerprints are one node from the start, so groups of copies
    cost one row; ``cells`` says how crowded buckets are cut; components never leave the executors.
    """
    fp = "__fp"
    table = materialize(fingerprints(docs, id_col, text_col, size, fp))
    own = materialize(_grouped(table, fp, F.col(f"`{id_col}`"), errors))
    named = join_counted(table, own, fp, table.count())
    return named.select(F.col(f"`{id_col}`"), F.lpad(F.lower(F.hex(fp)), 16, "0").alias("fingerprint"), F.col("__first").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, errors: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, null ids last;
    of several with that id the one with the smallest hash over all columns, and one of rows that
    are equal throughout. All columns pass through; an empty table stays empty."""
    fp, row = "__fp", "__row"
    keyed = docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    table = materialize(fingerprints(keyed, id_col, text_col, size, fp, (row,)))
    place = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(row).alias("row"))
    own = _grouped(table, fp, place, errors)
    first = materialize(own.select(F.col("__first.id").alias("__id"), F.col("__first.row").alias("__first_row")).distinct())
    is_first = keyed[id_col].eqNullSafe(first["__id"]) & (keyed[row] == first["__first_row"])
    repeated = table.groupBy(id_col, row).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").withColumnsRenamed({id_col: "__again_id", row: "__again"}).drop("__n")
    kept = keyed.join(first, is_first, "left_semi")
    if not repeated.isEmpty():  # only such rows have to meet to leave one of them
        again = kept[id_col].eqNullSafe(repeated["__again_id"]) & (kept[row] == repeated["__again"])
        kept = kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates([id_col, row]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
