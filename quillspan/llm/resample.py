"""Target-distribution importance resampling, with ranks by parallel sorting by regular sampling.

1. A scan counts each bucket of hashed features in the documents and in the target. Every bucket has a *gain*, a whole number.
2. A second scan scores the documents from the array of gains, adds a noise that depends on the id alone, and writes each
   task's rows as a locally sorted run.
3. Every run gives samples at regular places. Their quantiles are the splitters: a row's segment is the number of splitters
   before it, found for a whole batch at once by a binary search in arrays.
4. Segments are counted, and the counts before a segment give the rank of its first row. Only segments that hold rows to draw
   are exchanged; each is merged and numbered in one task.

Rows are compared by score, id, features and, last, their place in the runs, so no two rows are equal, and a segment stays
small even if all scores or ids are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.common import cut, shards
from quillspan.llm.words import word_pieces

#: Samples for each splitter; rows of a segment at most, about.
SAMPLES, SEGMENT = 16, 1_000_000
_KEY = ["k0", "k1", "k2", "k3", "k4"]


def bucket_pieces(raw: bytes, longest: int, buckets: int) -> Iterator[np.ndarray]:
    """The bucket of every run of 1 to ``longest`` words, in arrays of about a megabyte of text each."""
    tail: list[bytes] = []
    for piece in word_pieces(raw):
        yield np.fromiter(map(crc32, piece), np.uint32, len(piece)) % np.uint32(buckets)
        for size in range(2, longest + 1):
            own = tail[-(size - 1) :] + piece
            runs = [b" ".join(own[i : i + size]) for i in range(len(own) - size + 1)]
            yield np.fromiter(map(crc32, runs), np.uint32, len(runs)) % np.uint32(buckets)
        if longest > 1:
            tail = (tail + piece)[-(longest - 1) :]


def _counts(longest: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for raw in batch.column(0):
                for own in bucket_pieces(raw.as_py() or b"", longest, buckets):
                    held.append(own)
                    size += len(own)
                    if size >= 1 << 20:
                        total += np.bincount(np.concatenate(held), minlength=buckets)
                        held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(rows: DataFrame, *, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; ``buckets`` numbers reach the driver."""
    text = rows.select(F.col("text").cast("string").cast("binary").alias("text"))
    found = text.mapInArrow(_counts(longest, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, np.int64)
    for r in found:
        total[r.bucket] = r.n
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of (t + 1) * (S + B) / ((s + 1) * (T + B))) for each of the B buckets."""
    all_raw, all_target, size = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1) * float(all_raw + size) / ((s + 1) * float(all_target + size)))) for s, t in zip(map(float, raw), map(float, target), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """A Gumbel number in thousandths, floored, from the id alone; a null id counts as an empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(gain: np.ndarray, longest: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            features, words, weights = [], [], []
            for raw in batch.column(1):
                n = w = total = 0
                for i, own in enumerate(bucket_pieces(raw.as_py() or b"", longest, len(gain))):
                    n += len(own)
                    w += len(own) if i % longest == 0 else 0
                    total += int(gain[own].sum())
                features.append(n)
                words.append(w)
                weights.append(total)
            scores = [w + noise(i, seed) for w, i in zip(weights, ids, strict=True)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (ids, features, words, weights, scores)], names=["doc_id", "n_features", "n_words", "weight", "score"])

    return run


def places(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """For each column of ``keys``, how many columns of the sorted ``splitters`` are not after it, row 0 deciding first."""
    low = np.zeros(keys.shape[1], np.int64)
    high = np.full(keys.shape[1], splitters.shape[1], np.int64)
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high) // 2, 0)
        after = np.ones(keys.shape[1], bool)
        for key, split in zip(keys[::-1], splitters[::-1], strict=True):
            after = (key > split[mid]) | ((key == split[mid]) & after)
        low, high = np.where(open_ & after, mid + 1, low), np.where(open_ & ~after, mid, high)
    return low


def _dealt(splitters: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([batch.column(k).to_numpy() for k in _KEY])
            found = places(keys, splitters) if splitters.shape[1] else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "segment"])

    return run


def regular_splitters(runs: DataFrame, n: int, segments: int) -> np.ndarray:
    """The splitters of ``segments`` parts of ``runs``, whose rows hold the columns of the key and ``place``, their place in
    their sorted run. About ``SAMPLES`` samples a segment and one a run reach the driver."""
    step = max(1, n // (SAMPLES * segments))
    found = runs.filter(F.col("place") % step == step // 2).select(*_KEY).toArrow()
    keys = np.array([found.column(k).to_numpy() for k in _KEY], np.int64).reshape(len(_KEY), -1)
    keys = keys[:, np.lexsort(keys[::-1])]
    return keys[:, [len(keys[0]) * i // segments for i in range(1, segments)]] if keys.shape[1] >= segments else keys


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), all long, for every row of ``docs`` (doc_id, text; other columns are not read).

    Features are the runs of 1 to ``longest`` words, hashed to ``buckets``; ``weight`` is the sum of their gains towards the texts
    of ``target``, ``score`` adds a Gumbel noise of the id. Of the N rows with at least ``least_words`` words the
    floor(percent * N / 100) highest scores are drawn, ties to the smaller id, a null id last; ``rank`` is their order from 1,
    null for all others. Null texts have no words. Rows of one id have one noise and are drawn by themselves, those with fewer
    features first where scores are equal; exact repeats are as good as each other. Empty tables are allowed on either side.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    gain = gains(bucket_counts(own, longest=longest, buckets=buckets), bucket_counts(target, longest=longest, buckets=buckets))
    order = [F.col("n_words") < least_words, F.col("score").desc(), F.col("doc_id").isNull(), F.col("doc_id"), F.col("n_features")]
    scored = own.mapInArrow(_scores(gain, longest, seed), "doc_id long, n_features long, n_words long, weight long, score long")
    # After the local sort, ids that rise within a task are the rows' places in its run.
    runs = cut(scored.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "resample-runs")
    keyed = runs.filter(F.col("n_words") >= least_words).select(
        "doc_id", "n_features", "weight", "score", F.negative("score").alias("k0"), F.col("doc_id").isNull().cast("long").alias("k1"), F.coalesce("doc_id", F.lit(0)).alias("k2"), F.col("n_features").alias("k3"), F.col("at").alias("k4")
    )
    n = keyed.count()
    drawn = percent * n // 100
    segments = max(shards(spark), -(-n // segment))
    splitters = regular_splitters(keyed.withColumn("place", F.expr("k4 & 8589934591")), n, segments)
    dealt = cut(keyed.mapInArrow(_dealt(splitters), T.StructType([*keyed.schema.fields, T.StructField("segment", T.LongType())])), "resample-segments")
    counts = {r.segment: r.n for r in dealt.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # ``segments`` rows at most
    before, wanted = 0, []
    for k in sorted(counts):
        if before < drawn:
            wanted.append((k, before))
        before += counts[k]
    starts = spark.createDataFrame(wanted, "segment long, before long")
    place = F.row_number().over(Window.partitionBy("segment").orderBy(*_KEY))
    rank = F.col("before") + place
    some = dealt.join(F.broadcast(starts), "segment").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    last = wanted[-1][0] if wanted else -1
    none = F.lit(None).cast("long").alias("rank")
    rest = dealt.filter(F.col("segment") > last).select("doc_id", "n_features", "weight", "score", none)
    few = runs.filter(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", none)
    return some.unionByName(rest).unionByName(few)
