"""Nearest neighbours by inner product: a vantage-point tree for each shard of vectors."""

from __future__ import annotations

import io
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_arrow, materialize

_SLACK = 1e-9
#: Candidates for a vantage point, and the rows by which they are judged.
_TRIED, _JUDGED = 8, 256


@dataclass
class VPTree:
    """Vantage-point tree of the distinct vectors of one shard, in flat arrays.

    The largest inner product is the least Euclidean distance once each vector gets one more
    component that makes all norms equal, and the query a zero there. ``nodes`` has the first
    row, the end, and the near and far child of each node (-1: a leaf); ``points`` the row of
    its vantage point; ``bounds`` the least and most distance to it on the near and on the far
    side. ``ids`` and ``times`` say which rows a vector stands for: those from ``starts[row]``.
    """

    top: float
    nodes: np.ndarray
    points: np.ndarray
    bounds: np.ndarray
    vectors: np.ndarray
    ids: np.ndarray
    times: np.ndarray
    starts: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, times: np.ndarray | None = None, leaf: int = 128, seed: int = 5) -> VPTree:
        times = np.ones(len(ids), np.int64) if times is None else times
        vectors, which = np.unique(vectors, axis=0, return_inverse=True)
        which = which.reshape(-1)
        norm = (vectors**2).sum(1)
        top = float(norm.max()) if len(norm) else 0.0
        lifted = np.hstack([vectors, np.sqrt(np.maximum(0.0, top - norm))[:, None]])
        rows, rng = np.arange(len(vectors)), np.random.default_rng(seed)
        nodes, points, bounds = [[0, len(vectors), -1, -1]], [-1], [[0.0] * 4]
        at = 0
        while at < len(nodes):
            first, end, *_ = nodes[at]
            if end - first > leaf:
                own = rows[first:end]
                point = cls._vantage(lifted, own, rng)
                distance = np.sqrt(((lifted[own] - lifted[point]) ** 2).sum(1))
                half = len(own) // 2
                by = np.argpartition(distance, half)
                rows[first:end], distance = own[by], distance[by]
                points[at] = point
                bounds[at] = [f(distance[s]) for s in (slice(half), slice(half, None)) for f in (np.min, np.max)]
                nodes[at][2:] = len(nodes), len(nodes) + 1
                nodes += [[first, first + half, -1, -1], [first + half, end, -1, -1]]
                points += [-1, -1]
                bounds += [[0.0] * 4, [0.0] * 4]
            at += 1
        place = np.empty(len(rows), np.int64)
        place[rows] = np.arange(len(rows))
        order = np.lexsort((ids, place[which]))
        starts = np.searchsorted(place[which][order], np.arange(len(rows) + 1))
        moved = np.array([place[p] if p >= 0 else -1 for p in points], np.int64)
        return cls(top, np.array(nodes, np.int64), moved, np.array(bounds), vectors[rows], ids[order], times[order], starts)

    @staticmethod
    def _vantage(lifted: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> int:
        """Of a few rows, the one whose distances to some of the others spread most."""
        tried, judged = rng.choice(own, min(_TRIED, len(own)), replace=False), rng.choice(own, min(_JUDGED, len(own)), replace=False)
        spread = [np.sqrt(((lifted[judged] - lifted[t]) ** 2).sum(1)).var() for t in tried]
        return int(tried[int(np.argmax(spread))])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **(self.__dict__ | {"top": np.float64(self.top)}))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> VPTree:
        with np.load(io.BytesIO(data), allow_pickle=False) as held:
            return cls(**{k: float(held[k]) if k == "top" else held[k] for k in held.files})

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float = 1.0, floor: np.ndarray | None = None) -> tuple[list[list[tuple[float, int, int]]], np.ndarray]:
        """The best (score, id, times) of each query, best first, ties to smaller ids, until they
        stand for k rows or more; and how many vectors each query was compared with.

        A query is a row itself: once its own id with its own vector is not counted. ``floor``
        has the k-th best score that each query has elsewhere. A subtree is left out if, by the
        triangle inequality, none of its vectors can be nearer than the k-th best so far;
        ``factor`` above 1 multiplies that lower bound and so leaves out more; with 1 nothing is
        missed.
        """
        n = len(queries)
        best, found = [np.zeros(0)] * n, [np.zeros(0, np.int64)] * n
        kth = np.full(n, -np.inf) if floor is None else floor.copy()
        squared = (queries**2).sum(1)
        slack = _SLACK * (np.sqrt(squared * self.top) + 1e-300)
        sizes = np.add.reduceat(np.append(self.times, 0), self.starts[:-1]) if len(self.ids) else np.zeros(0, np.int64)
        compared = np.zeros(n, np.int64)

        def leaf(first: int, end: int, active: np.ndarray) -> None:
            compared[active] += end - first
            block = queries[active] @ self.vectors[first:end].T
            enough = block >= (kth[active] - slack[active])[:, None]
            some = np.flatnonzero(enough.any(1))
            for q, scores, keep in zip(active[some].tolist(), block[some], enough[some], strict=True):
                rows = np.flatnonzero(keep)
                scores = np.concatenate([best[q], scores[rows]])
                rows = np.concatenate([found[q], rows + first])
                by = np.argsort(-scores, kind="stable")
                scores, rows = scores[by], rows[by]
                last = int(np.searchsorted(np.cumsum(sizes[rows]), k + 1))  # one more, for the query itself
                if last < len(rows):
                    kth[q] = max(kth[q], scores[last])
                    keep = scores >= kth[q] - 2 * slack[q]
                    scores, rows = scores[keep], rows[keep]
                best[q], found[q] = scores, rows

        waiting = [(0, np.arange(n), np.zeros(n))] if len(self.vectors) else []
        while waiting:
            node, active, least = waiting.pop()
            # the distance that the k-th best score stands for
            reach = np.sqrt(np.maximum(0.0, squared[active] + self.top - 2 * np.maximum(kth[active], -1e300)))
            active = active[least * factor <= reach * (1 + 1e-7) + 1e-7]
            first, end, near, far = self.nodes[node].tolist()
            if not len(active):
                continue
            if near < 0:
                leaf(first, end, active)
                continue
            distance = np.sqrt(np.maximum(0.0, squared[active] + self.top - 2 * (queries[active] @ self.vectors[self.points[node]])))
            low_near, high_near, low_far, high_far = self.bounds[node]
            to_near = np.maximum(0.0, np.maximum(low_near - distance, distance - high_near))
            to_far = np.maximum(0.0, np.maximum(low_far - distance, distance - high_far))
            turn = to_near <= to_far  # these go to the near side first; what is pushed last comes first
            for child, bound, which in ((far, to_far, turn), (near, to_near, ~turn), (far, to_far, ~turn), (near, to_near, turn)):
                if which.any():
                    waiting.append((child, active[which], bound[which]))
        return [self._listed(queries[q], int(own[q]), found[q], k) for q in range(n)], compared

    def _listed(self, query: np.ndarray, own: int, rows: np.ndarray, k: int) -> list[tuple[float, int, int]]:
        # summed from the first component to the last, as a plain loop would
        exact = np.cumsum(self.vectors[rows] * query, axis=1)[:, -1] if len(rows) else np.zeros(0)
        out = []
        for score, row in zip(exact.tolist(), rows.tolist(), strict=True):
            a, b = self.starts[row], self.starts[row + 1]
            ids, times = self.ids[a : min(b, a + k + 1)].tolist(), self.times[a : min(b, a + k + 1)].tolist()
            if own in ids and (self.vectors[row] == query).all():
                times[ids.index(own)] -= 1
            out += [(score, i, t) for i, t in zip(ids, times, strict=True) if t]
        return best_of(out, k)


def best_of(pairs: list[tuple[float, int, int]], k: int) -> list[tuple[float, int, int]]:
    """The best (score, id, times), until they stand for k rows."""
    pairs.sort(key=lambda p: (-p[0], p[1]))
    have = 0
    for i, p in enumerate(pairs):
        have += p[2]
        if have >= k:
            return pairs[: i + 1]
    return pairs


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v as doubles, times) of the rows with an id and a vector of finite components, not all
    zero; rows that repeat both are one, ``times`` over."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    some = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)))
    return some.groupBy("id", "v").agg(F.count(F.lit(1)).alias("times"))


def build_index(vectors: DataFrame, shard_rows: int = 8192) -> DataFrame:
    """(dim, shard, tree) of vectors (id, v, times): about ``shard_rows`` vectors a tree, dealt by a
    hash of id and vector, so an id or a vector that repeats spreads over all shards; every vector
    is in one tree."""
    n = vectors.count()
    shards = max(1, math.ceil(n / shard_rows))
    dealt = vectors.select("id", "v", "times", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard"))

    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        tree = VPTree.build(table.column("id").to_numpy(), flat, table.column("times").to_numpy())
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "tree": pa.array([tree.to_bytes()], pa.binary())})

    return dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard long, tree binary")


def nearest(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, factor: float = 1.0, shard_rows: int = 8192, block_bytes: int = 8 << 20
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest by inner product, for each row whose id
    is divisible by ``every``, among all other rows.

    Ties go to the smaller id; fewer candidates than k give fewer rows. Null vectors, zero ones
    and those with null or non-finite components take no part, nor do null ids; vectors of
    different lengths are not compared. Rows that repeat an id are queries and candidates each,
    also for one another; if they repeat the vector too, their results are repeated. An empty
    table gives none; other columns are not read. ``factor`` 1 is exact; more prunes more and may
    miss neighbours.

    Queries go in blocks of ``block_bytes`` of vectors, which alone reach all tasks; each task
    searches its trees one by one, carries the k-th best score from tree to tree, and hands over
    no more than k rows a query.
    """
    vectors = materialize(usable_vectors(table, id_col, vector_col))
    index = materialize(build_index(vectors, shard_rows))
    queries = vectors.filter(F.col("id") % every == 0)
    spark = table.sparkSession
    schema = T.StructType([field("q", T.LongType()), field("query_id", T.LongType()), field("copies", T.LongType()), field("vec_id", T.LongType()), field("score", T.DoubleType()), field("times", T.LongType())])
    tasks = max(1, spark.sparkContext.defaultParallelism, index.count() // 4)
    index = index.repartition(tasks, F.xxhash64("dim", "shard"))

    def searched(part: list[tuple[int, list[float], int]]) -> DataFrame:
        by_dim: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for dim in {len(v) for _, v, _ in part}:
            own = [(q, i, v) for q, (i, v, _) in enumerate(part) if len(v) == dim]
            by_dim[dim] = (np.array([q for q, _, _ in own], np.int64), np.array([i for _, i, _ in own], np.int64), np.array([v for _, _, v in own], np.float64).reshape(len(own), dim))
        sent = spark.sparkContext.broadcast((by_dim, np.array([t for _, _, t in part], np.int64)))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, copies = sent.value
            best: dict[int, list[list[tuple[float, int, int]]]] = {}
            floor: dict[int, np.ndarray] = {}
            for batch in batches:
                for dim, tree in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                    if dim not in asked:
                        continue
                    _, ids, vectors = asked[dim]
                    have = best.setdefault(dim, [[] for _ in ids])
                    kth = floor.setdefault(dim, np.full(len(ids), -np.inf))
                    for q, pairs in enumerate(VPTree.from_bytes(tree.as_py()).search(vectors, ids, k, factor, kth)[0]):
                        have[q] = best_of(have[q] + pairs, k)
                        if sum(t for *_, t in have[q]) >= k:
                            kth[q] = have[q][-1][0]
            rows = [(int(asked[dim][0][q]), int(asked[dim][1][q]), int(copies[asked[dim][0][q]]), i, s, t) for dim, have in best.items() for q, pairs in enumerate(have) for s, i, t in pairs]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.float64() if name == "score" else pa.int64()) for c, name in enumerate(schema.names)], names=schema.names)

        near = map_arrow(index, run, schema)
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        single = near.select("q", "query_id", "copies", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k).cast("long")))))
        ranked = single.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        each = ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    out: DataFrame | None = None
    part: list[tuple[int, list[float], int]] = []
    held = 0
    # one block at a time on the driver; results of earlier blocks wait in the shared folder
    for row in queries.toLocalIterator():
        part.append((row["id"], row["v"], row["times"]))
        held += 8 * len(row["v"])
        if held >= block_bytes:
            done = materialize(searched(part))
            out = done if out is None else out.union(done)
            part, held = [], 0
    last = searched(part) if part or out is None else None
    return last if out is None else out if last is None else out.union(last)
