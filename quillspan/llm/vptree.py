"""Approximate nearest neighbours by vantage-point trees, one a shard.

On unit vectors the Euclidean distance is a metric and falls as the cosine rises. A tree splits its points at the median
distance to a vantage point; a search skips a side that, by the triangle inequality, cannot hold a point nearer than the
k-th found so far. ``factor`` over one makes that test stricter than the inequality allows, which skips more and may miss
neighbours; one restores exact search.

Shards hold a bounded number of vectors, dealt by the hash of their id. Every query goes to every shard (a stated query set
against all rows) and brings back its k best of each; a last step ranks these. Of equal vectors a shard keeps the k + 1
smallest ids, which are all that can be among the k nearest, so a vector that fills a third of all rows costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF, QUERIES = 256, 1024
SLACK = 1e-9  # of a distance: rounding never skips a tie


class VPTree:
    """Points are rows of ``vectors`` (float64, none zero) with their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt(np.einsum("nd,nd->n", vectors, vectors))
        self.nodes: list[tuple] = []
        self.root = self._grow(np.arange(len(ids)))

    def _grow(self, own: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(own) <= LEAF:
            self.nodes[at] = (own,)
            return at
        unit = self.vectors[own] / self.norms[own, None]
        d = np.sqrt(np.maximum(0, 2 - 2 * (unit @ unit[0])))
        mu = float(np.median(d))
        inner, outer = own[d <= mu], own[d > mu]
        if not len(outer):  # all as far as the median: halves do as well
            inner, outer = own[: len(own) // 2], own[len(own) // 2 :]
            low, high = float(d.min()), float(d.max())
        else:
            low, high = float(d[d > mu].min()), float(d.max())
        self.nodes[at] = (own[0], mu if len(outer) and (d > mu).any() else high, low, high, self._grow(inner), self._grow(outer))
        return at

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k nearest of each query, nearest first, ties by id; -inf and -1 where there are fewer.

        A point with the query's own id is left out. Scores are cosines in double precision.
        """
        n = len(queries)
        norms = np.sqrt(np.einsum("nd,nd->n", queries, queries))
        scores, ids = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        reach = np.full(n, np.inf)

        def cosines(q: np.ndarray, own: np.ndarray) -> np.ndarray:
            return np.einsum("qd,nd->qn", queries[q], self.vectors[own]) / (norms[q, None] * self.norms[own])

        def leaf(q: np.ndarray, own: np.ndarray) -> None:
            s = cosines(q, own)
            s[self.ids[own] == query_ids[q, None]] = -np.inf
            better = (s >= scores[q, -1:]).any(1)
            q, s = q[better], s[better]
            every = np.concatenate([scores[q], s], 1)
            names = np.concatenate([ids[q], np.broadcast_to(self.ids[own], s.shape)], 1)
            names[every == -np.inf] = -1
            order = np.lexsort((names, -every), axis=1)[:, :k]
            scores[q], ids[q] = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)
            last = scores[q, -1]
            reach[q] = np.where(last == -np.inf, np.inf, np.sqrt(np.maximum(0, 2 - 2 * last)) + SLACK)

        def far(q: np.ndarray, node: tuple) -> np.ndarray:
            return np.sqrt(np.maximum(0, 2 - 2 * cosines(q, np.array([node[0]]))[:, 0]))

        def walk(at: int, q: np.ndarray, greedy: bool) -> None:
            node = self.nodes[at]
            if len(node) == 1:
                leaf(q, node[0])
                return
            d = far(q, node)
            near = d <= (node[1] + node[2]) / 2
            for own, first in ((near, True), (~near, False)):
                for side in (first, not first):
                    if greedy and side != first:
                        continue
                    gap = d - node[1] if side else np.maximum(node[2] - d, d - node[3])
                    go = own if greedy else own & (gap * factor <= reach[q])
                    if go.any():
                        walk(node[4] if side else node[5], q[go], greedy)

        if len(self.ids) and n:
            walk(self.root, np.arange(n), True)
            scores[:], ids[:] = -np.inf, -1  # the reach stays; points are met again
            walk(self.root, np.arange(n), False)
        return scores, ids


def _valid(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray | None]:
    found = []
    for v in column:
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid else np.zeros(0)
        good = len(x) and np.isfinite(x).all() and x.any()
        # Scaled by a power of two, which changes no cosine, so that squares neither overflow nor vanish.
        found.append(np.ldexp(x, -np.frexp(np.abs(x).max())[1]) if good else None)
    return found


def _search(k: int, factor: float):
    """One task: rows (shard, is_query, id, vec) sorted by shard, its points before its queries, to (query, vec, score)."""
    schema = pa.schema([("query_id", pa.int64()), ("query_hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def answer(trees: dict[int, VPTree], rows: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for size in {len(r[2]) for r in rows} & trees.keys():
            own = [r for r in rows if len(r[2]) == size]
            names, hashes = np.array([r[0] for r in own], np.int64), np.array([r[1] for r in own], np.int64)
            scores, ids = trees[size].search(names, np.stack([r[2] for r in own]), k, factor)
            q, at = np.nonzero(scores > -np.inf)
            yield pa.record_batch([pa.array(names[q]), pa.array(hashes[q]), pa.array(ids[q, at]), pa.array(scores[q, at])], schema=schema)

    def plant(points: dict[int, bytes]) -> dict[int, VPTree]:
        alike: dict[bytes, list[int]] = {}
        for name, raw in points.items():
            alike.setdefault(raw, []).append(name)
        by_size: dict[int, list[tuple[int, bytes]]] = {}
        for raw, names in alike.items():
            by_size.setdefault(len(raw) // 8, []).extend((i, raw) for i in sorted(names)[: k + 1])
        return {n: VPTree(np.array([i for i, _ in rows], np.int64), np.frombuffer(b"".join(r for _, r in rows)).reshape(-1, n)) for n, rows in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, points, trees, rows = None, {}, None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "is_query", "id", "hash"))
            for own, is_query, name, hashed, vec in zip(*columns, _valid(batch.column("vec")), strict=True):
                if own != shard:
                    if rows:
                        yield from answer(trees, rows)
                    shard, points, trees, rows = own, {}, None, []
                if vec is None:
                    continue
                if not is_query:
                    raw = vec.tobytes()
                    points[name] = min(points.get(name, raw), raw)
                    continue
                if trees is None:
                    trees = plant(points)
                rows.append((name, hashed, vec))
                if len(rows) >= QUERIES:
                    yield from answer(trees, rows)
                    rows = []
        if rows:
            yield from answer(trees, rows)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, factor: float = 1.0, shard_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``vectors`` (vec_id, embedding) for each row of ``queries``.

    Nearest is the largest cosine; ties go to the smaller vec_id; a row with the query's own vec_id is left out. Rows whose
    id is null or whose vector is null, empty, zero or holding null or non-finite components take no part; vectors of
    different lengths never meet. Repeated rows count once; of different vectors with one vec_id the one whose bytes come first
    is a candidate, and each is a query. Fewer candidates than k give fewer rows; empty tables none.
    """
    parts = -(-vectors.count() // shard_rows) or 1
    vec = F.col("embedding").cast("array<double>")
    plain = lambda df: df.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), vec.alias("vec"))
    points = plain(vectors).select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("shard"), F.lit(False).alias("is_query"), "id", F.lit(0).cast("long").alias("hash"), "vec")
    asked = plain(queries).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("shard"), F.lit(True).alias("is_query"), "id", F.xxhash64("vec").alias("hash"), "vec")
    found = points.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "is_query").mapInArrow(_search(k, factor), "query_id long, query_hash long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "query_hash", "vec_id"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
