"""SimHash near-dedup: fingerprints of word shingles, linked by BK-trees.

A BK-tree's children are keyed by their whole Hamming distance to the parent; a search around a point at distance d from
a node follows only the edges from d - radius to d + radius. A tree over all fingerprints would have to be sent to every
task and would grow with the data, so the trees are sharded by the pigeonhole rule: 64 bits in ``radius + 2`` blocks, of
which two fingerprints within the radius share at least two. Each pair of blocks makes one key, a shard tree holds the
different fingerprints of one key, and it goes to one task by the shuffle. No link is lost, and every link is found
between different fingerprints only: equal ones are collapsed first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import cut
from quillspan.llm.components import connected_components

#: Different fingerprints of a key beyond which its tree is dealt out to several tasks.
SHARD = 20_000
#: Pairs of a query and a node that a search holds at once.
PAIRS = 200_000


def fingerprint(words: list[bytes], width: int = 4) -> int:
    """The 64-bit SimHash of ``width``-word shingles, repeats included; fewer words make one shingle, none gives zero."""
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        h = np.array([digest(b" ".join(words[i : i + width]), 42) for i in range(at, min(n, at + 65_536))], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = np.array([fingerprint((t or b"").lower().split(), width) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null texts count as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(width), "doc_id long, fp long")


class Forest:
    """BK-trees over many shards at once, built and searched level by level in numpy.

    ``shard`` and ``points`` are parallel; the first point of a shard is its root. Points of a shard must differ.
    """

    def __init__(self, shard: np.ndarray, points: np.ndarray) -> None:
        self.points = points
        n = len(points)
        order = np.argsort(shard, kind="stable")
        first = np.r_[True, shard[order][1:] != shard[order][:-1]] if n else np.zeros(0, bool)
        self.root_of = np.empty(n, np.int64)
        self.root_of[order] = order[first][np.cumsum(first) - 1] if n else 0
        node, todo = self.root_of.copy(), np.flatnonzero(self.root_of != np.arange(n))
        node = node[todo]
        parents, edges, children = [], [], []
        while len(todo):
            d = np.bitwise_count(points[todo] ^ points[node]).astype(np.int64)
            key = node * 65 + d
            _, at, back = np.unique(key, return_index=True, return_inverse=True)
            parents.append(node[at]), edges.append(d[at]), children.append(todo[at])
            down = np.ones(len(todo), bool)
            down[at] = False
            todo, node = todo[down], todo[at][back][down]
        key = np.concatenate(parents) * 65 + np.concatenate(edges) if parents else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.key, self.child = key[order], (np.concatenate(children)[order] if children else np.zeros(0, np.int64))

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of queries, places of points) within the radius, in parts; each query looks in its root's tree."""
        todo = [(np.arange(len(queries)), roots)]
        while todo:
            q, node = todo.pop()
            d = np.bitwise_count(queries[q] ^ self.points[node]).astype(np.int64)
            if (near := d <= radius).any():
                yield q[near], node[near]
            low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right") - low
            some = n > 0
            q, low, n = q[some], low[some], n[some]
            for at in np.split(np.arange(len(q)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1) if len(q) else []:
                m = n[at]
                down = np.repeat(low[at] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
                todo.append((np.repeat(q[at], m), self.child[down]))


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a and b in ``label``, where each place points to a smaller one or itself."""
    while True:
        ra, rb = label[a], label[b]
        if (differ := ra != rb).any():
            np.minimum.at(label, np.maximum(ra[differ], rb[differ]), np.minimum(ra[differ], rb[differ]))
        while (nxt := label[label] != label).any():
            label[nxt] = label[label[nxt]]
        if not differ.any():
            return


def _links(radius: int):
    """One task: rows (cell, half, fp), sorted by cell, to links between each fingerprint and the least of its set.

    A cell is a shard's tree, or for a large shard two parts of it: half 0 is then searched for half 1.
    """

    def flush(cell: np.ndarray, half: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        points, label = fp.view(np.uint64), np.arange(len(fp))
        base, other = np.flatnonzero(half == 0), np.flatnonzero(half == 1)
        forest = Forest(cell[base], points[base])
        root = {int(c): int(r) for c, r in zip(cell[base], forest.root_of, strict=True)}
        for own, queries in ((True, base), (False, other)):
            roots = forest.root_of if own else np.array([root.get(int(c), -1) for c in cell[queries]], np.int64)
            queries, roots = queries[roots >= 0], roots[roots >= 0]
            for q, p in forest.search(points[queries], roots, radius):
                differ = queries[q] != base[p]
                _settle(label, queries[q[differ]], base[p[differ]])
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.record_batch([pa.array(fp[linked]), pa.array(fp[label[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "half", "fp")])
            kept.append(rows)
            if sum(x.shape[1] for x in kept) >= 200_000:  # whole cells so far; the last one may go on
                rows = np.concatenate(kept, axis=1)
                end = int(np.searchsorted(rows[0], rows[0, -1]))
                kept = [rows[:, end:]]
                if end:
                    yield flush(*rows[:, :end])
        if kept and (rows := np.concatenate(kept, axis=1)).shape[1]:
            yield flush(*rows)

    return run


def hamming_links(fps: DataFrame, radius: int = 4, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that join all fingerprints ``fp`` (distinct longs) that a chain of steps of ``radius`` bits joins.

    Within a shard only links to one fingerprint of each joined set are returned, never all pairs. Nulls have no links, repeated
    fingerprints do no harm, other columns are not read, and an empty table has no links.
    """
    blocks = radius + 2
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for n, pair in enumerate(combinations(range(blocks), 2)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in pair)
        keys.append(F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)), F.lit(n)))
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("cell"))
    over = cut(keyed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > shard), "simhash-large")
    keyed = keyed.join(over, "cell", "left")
    small = keyed.filter("n is null").select("cell", F.lit(0).alias("half"), "fp")
    # A large shard: part i against part j in cells of their own, so no task holds more than two parts.
    parts = F.ceil(F.col("n") / shard).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    large = (
        keyed.filter("n is not null")
        .withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), (F.col("own") > F.col("other")).cast("int").alias("half"), "fp")
    )
    return small.unionByName(large).repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(radius), "a long, b long")


def simhash_components(docs: DataFrame, *, radius: int = 4, width: int = 4, shard: int = SHARD) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text; other columns are not read).

    Texts are lower-cased (A-Z) and split at ASCII white space. ``component_id`` is the smallest doc_id that links of
    ``radius`` bits or fewer reach. Null and empty texts have fingerprint 0 and link like any other. A null doc_id is
    kept as a row and never names a component unless the component has no other id. Repeated rows stay.
    """
    found = cut(fingerprints(docs, width), "simhash")
    unique = cut(found.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-unique")
    roots = connected_components(hamming_links(unique.select("fp"), radius, shard))
    named = unique.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = cut(named.select("fp", "root").join(names, "root").select("fp", "component_id"), "simhash-names")
    return found.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, radius: int = 4, width: int = 4) -> DataFrame:
    """``docs`` with the row of the smallest doc_id of each component; all columns stay, repeated rows once."""
    kept = simhash_components(docs, radius=radius, width=width).filter("doc_id <=> component_id").select(F.col("doc_id").alias("keep_doc")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["keep_doc"]), "left_semi").dropDuplicates(["doc_id"])
