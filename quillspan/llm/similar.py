"""Near-dedup by word-shingle similarity: SimHash fingerprints of all texts in BK-trees, then MinHash bands for what they leave.

SimHashes of all texts are linked by the sharded BK-trees of ``simhash``, within ``NEAR`` bits, and each link is verified on the
whole shingle sets. Bit blocks can shard BK-trees only for so small a radius, which few pairs at a Jaccard similarity of 0.8 are
within, so texts that share a band of MinHash values meet too. Each is first compared with one representative of its band, on the whole
shingle sets; those that are similar to it are joined and need no comparison among themselves, so a large group of copies
costs one comparison a member. Only texts that their band's representative leaves search a BK-tree of the band's other
texts, along the edges within a wide radius, and each pair found is verified. Large bands are dealt to several trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import cut, held
from quillspan.llm.components import connected_components
from quillspan.llm.simhash import Forest, _settle, hamming_links

#: At a similarity of 0.8 a pair shares no band with probability (1 - 0.8**5)**24, about 7 in 100,000.
BANDS, ROWS = 24, 5
#: Bits that SimHash fingerprints of such pairs differ by: 9.7 on average, 2.9 deviation.
RADIUS = 24
#: Bits within which the fingerprints of all texts are linked.
NEAR = 4
SHARD = 2000
_A = np.random.default_rng(7).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(8).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, one without words has none."""
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)), np.uint64, n))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(len(_A), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        low = np.minimum(low, (_A[:, None] * hashes[at : at + 4096] + _B[:, None]).min(1))
    rows = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def sketch(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        votes += np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def _bands(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held(batches):
            keys, fps = [], []
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                hashes = shingle_set(t, width)
                keys.append(band_keys(hashes))
                fps.append(sketch(hashes) if len(hashes) else None)
            ends = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            signed = pa.array([None if f is None else f - (1 << 64) if f >> 63 else f for f in fps], pa.int64())
            yield pa.record_batch([batch.column("u"), batch.column("doc_id"), signed, bands], names=["u", "doc_id", "fp", "bands"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held(batches):
            found = [shingle_set(t, width) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            fps = np.array([sketch(h) for h in found], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("u"), pa.array(fps), pa.array([h.tobytes() for h in found], pa.binary())], names=["u", "fp", "hashes"])

    return run


def _against_first(threshold: float):
    """One task: rows (rep, salt, member, u, hashes) in order, each representative's own before its members', to whether the
    member is similar to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: np.ndarray | None = None
        for batch in held(batches, "hashes"):
            rep, u, same = [], [], []
            for own, member, name, raw in zip(*(batch.column(c).to_pylist() for c in ("rep", "member", "u", "hashes")), strict=True):
                hashes = np.frombuffer(raw, np.uint64)
                if not member:
                    head = hashes
                    continue
                rep.append(own)
                u.append(name)
                same.append(min(len(head), len(hashes)) >= threshold * max(len(head), len(hashes)) and jaccard(head, hashes) >= threshold)
            yield pa.record_batch([pa.array(rep, pa.int64()), pa.array(u, pa.int64()), pa.array(same, pa.bool_())], names=["rep", "u", "same"])

    return run


def _links(threshold: float, radius: int):
    """One task: rows (cell, asks, same, u, fp, hashes), sorted by cell, to links between rows that ask and others of their
    cell at the threshold or above. Rows that are ``same`` as their band's representative are one set from the start."""

    def flush(rows: list[tuple]) -> tuple[list[int], list[int]]:
        asks = np.array([r[1] for r in rows])
        u = np.array([r[3] for r in rows])
        fps = np.array([r[4] for r in rows]).view(np.uint64)
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        base, asked = np.flatnonzero(~asks), np.flatnonzero(asks)
        unique, where = np.unique(fps[base], return_inverse=True)  # a tree's points differ
        a_out, b_out = [], []
        if not len(unique) or not len(asked):
            return a_out, b_out
        forest = Forest(np.zeros(len(unique), np.int64), unique)
        members = np.argsort(where, kind="stable")
        start = np.r_[0, np.cumsum(np.bincount(where, minlength=len(unique)))]
        _, first, place = np.unique(u, return_index=True, return_inverse=True)
        label = first[place]  # a text that stands on both sides is one
        if len(joined := np.flatnonzero([r[2] for r in rows])):
            _settle(label, joined, np.full(len(joined), joined[0]))
        for q, p in forest.search(fps[asked], np.full(len(asked), forest.root_of[0]), radius):
            n = start[p + 1] - start[p]
            left = np.repeat(asked[q], n)
            right = base[members[np.repeat(start[p] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]]
            while True:
                apart = label[left] != label[right]
                left, right = left[apart], right[apart]
                if not len(left):
                    break
                # Each set's first pair with another set: verified, then joined sets need no more.
                _, at = np.unique(left, return_index=True)
                good = [i for i in at if jaccard(sets[left[i]], sets[right[i]]) >= threshold]
                if good:
                    _settle(label, left[good], right[good])
                    a_out += u[left[good]].tolist()
                    b_out += u[right[good]].tolist()
                rest = np.ones(len(left), bool)
                rest[at] = False
                left, right = left[rest], right[rest]
        return a_out, b_out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in held(batches, "hashes"):
            a_all, b_all = [], []
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "asks", "same", "u", "fp", "hashes")), strict=True):
                if row[0] != cell:
                    a, b = flush(rows) if rows else ([], [])
                    a_all += a
                    b_all += b
                    cell, rows = row[0], []
                rows.append(row)
            yield pa.record_batch([pa.array(a_all, pa.int64()), pa.array(b_all, pa.int64())], names=["a", "b"])
        if rows:
            a, b = flush(rows)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _tree_pairs(found: DataFrame) -> DataFrame:
    """(rep, u, n): texts of ``found`` (u, fp) beside one text of the fingerprints that BK-trees join to theirs, and how many
    texts that one has beside it. Texts without words have no fingerprint."""
    texts = found.filter("fp is not null").select("u", "fp").distinct()
    unique = cut(texts.groupBy("fp").agg(F.min("u").alias("low")), "similar-fingerprints")
    roots = cut(connected_components(hamming_links(unique.select("fp"), NEAR)), "similar-roots")
    named = unique.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = named.groupBy("root").agg(F.min("low").alias("rep"))
    pairs = texts.join(named.select("fp", "root"), "fp").join(heads, "root").filter("u <> rep").select("rep", "u")
    return pairs.join(pairs.groupBy("rep").agg(F.count("*").alias("n")), "rep")


def _groups(docs: DataFrame, width: int, threshold: float, radius: int, shard: int) -> DataFrame:
    """(u, doc_id, root): ``u`` names a row's id and text, ``root`` its component."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("u", F.xxhash64("doc_id", "text"))
    found = cut(rows.mapInArrow(_bands(width), "u long, doc_id long, fp long, bands array<long>"), "similar-bands")
    by_tree = cut(_tree_pairs(found), "similar-trees")
    keyed = found.dropDuplicates(["u"]).select("u", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("u").alias("rep")).filter("n > 1")
    needed = cut(keyed.join(shared, "key").select("key", "u", "n", "rep"), "similar-shared")
    sets = cut(rows.select("u", "text").join(needed.select("u").unionByName(by_tree.select("u")).unionByName(by_tree.select(F.col("rep").alias("u"))).distinct(), "u", "left_semi").dropDuplicates(["u"]).mapInArrow(_sets(width), "u long, fp long, hashes binary"), "similar-sets")
    # A representative of very many is copied to several keys, and each member meets one copy.
    parts = lambda n: F.ceil(F.col(n) / shard).cast("int")
    pairs = needed.filter("u <> rep").select("rep", "u", "n").unionByName(by_tree).groupBy("rep", "u").agg(F.max("n").alias("n"))
    members = pairs.select("rep", F.pmod(F.xxhash64("u"), parts("n")).cast("int").alias("salt"), F.lit(True).alias("member"), "u").join(sets, "u")
    heads = pairs.groupBy("rep").agg(F.max("n").alias("n")).select("rep", F.explode(F.sequence(F.lit(0), parts("n") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("rep").alias("u")).join(sets, "u")
    columns = ["rep", "salt", "member", "u", "hashes"]
    met = members.select(*columns).unionByName(heads.select(*columns)).repartition("rep", "salt").sortWithinPartitions("rep", "salt", "member")
    judged = cut(met.mapInArrow(_against_first(threshold), "rep long, u long, same boolean"), "similar-judged")
    marked = needed.filter("u <> rep and n > 2").join(judged, ["rep", "u"]).select("key", "u", "n", "same")
    left = marked.filter("not same").groupBy("key").agg(F.count("*").alias("r"))
    # Part p of a band's texts against part q of those that its representative leaves, in cells of their own.
    rest = cut(marked.join(left, "key").withColumn("ps", parts("n")).withColumn("qs", parts("r")), "similar-rest")
    own = lambda tag, n: F.pmod(F.xxhash64("u", F.lit(tag)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = rest.withColumn("p", own("p", "ps")).withColumn("q", every("qs")).withColumn("asks", F.lit(False))
    asked = rest.filter("not same").withColumn("q", own("q", "qs")).withColumn("p", every("ps")).withColumn("asks", F.lit(True))
    cells = base.unionByName(asked.select(*base.columns)).select(F.xxhash64("key", "p", "q").alias("cell"), "asks", "same", "u")
    more = cells.join(sets, "u").repartition("cell").sortWithinPartitions("cell").select("cell", "asks", "same", "u", "fp", "hashes").mapInArrow(_links(threshold, radius), "a long, b long")
    roots = connected_components(judged.filter("same").select(F.col("u").alias("a"), F.col("rep").alias("b")).unionByName(more))
    return found.select("u", "doc_id").join(roots.withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))


def similar_components(docs: DataFrame, *, width: int = 5, threshold: float = 0.8, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(u, doc_id, component_id) for each row of ``docs`` (doc_id, text; other columns are not read).

    Texts whose sets of ``width``-word shingles (A-Z lower-cased) have a Jaccard similarity of ``threshold`` or more are
    linked; ``component_id`` is the smallest doc_id that links reach, null if none of these has one. ``u`` is a hash of id and
    text; equal rows share it. Texts without words, null ones too, link to nothing; an empty table gives an empty result.
    """
    named = _groups(docs, width, threshold, radius, shard)
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(names, "root").select("u", "doc_id", "component_id")


def keep_one(docs: DataFrame, *, width: int = 5, threshold: float = 0.8, shard: int = SHARD) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, null last, and of equal ids that of the smallest
    hash. All columns stay, whatever their names; of repeated rows (same id and text) one stays. Rows without words are
    components of their own. An empty table gives an empty result."""
    own = "similar_u"
    while own in docs.columns:
        own += "_"
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "u"))["u"]
    kept = _groups(docs, width, threshold, RADIUS, shard).groupBy("root").agg(best.alias(own)).select(own)
    return docs.withColumn(own, F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")))).join(kept, own, "left_semi").dropDuplicates([own]).drop(own)
