"""Toxicity by non-negative positive-unlabelled learning.

The classifier is trained from confirmed toxic texts and unlabelled ones; no text is taken for clean. With class prior p
the risk is p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)]): the second part estimates the clean texts' risk from the
unlabelled ones, and where it falls below zero, training steps back from it (Kiryo and others, 2017).

Features are words and word beginnings that are more frequent among the confirmed texts than among the unlabelled ones.
Both samples are bounded; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import cut, fold

#: Confirmed and unlabelled documents to learn from, at most about; hash bits of features; features of the classifier.
POSITIVE, UNLABELLED, BITS, FEATURES = 3000, 6000, 20, 1024
BEGINNINGS = (4, 5, 6, 7)
SHARE = 0.4  # of toxic texts among those with a feature, at least
STRIP = bytes(c for c in range(128) if not chr(c).isalpha())
REMEMBERED = 300_000


def keys_of(word: bytes) -> list[int]:
    """Hashes of a word and its beginnings."""
    core = word.strip(STRIP)
    if not core:
        return []
    mask = (1 << BITS) - 1
    return [crc32(b"w" + core) & mask, *(crc32(b"b" + core[:n]) & mask for n in BEGINNINGS if n < len(core))]


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode().split())


@dataclass
class Classifier:
    place: dict[int, int]  # hash to feature
    weights: np.ndarray
    bias: float
    known: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        """The probability that the text is toxic."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, place, found = self.known, self.place, set()
        for w in words_of(text):
            own = known.get(w)
            if own is None:
                own = known[w] = tuple(place[k] for k in keys_of(w) if k in place)
            if own:
                found.update(own)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[sorted(found)].sum(), -30, 30))))


def useful(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """Places of the features, most telling first, from their counts among confirmed and unlabelled texts."""
    rate, base = p / n_p, (u + 1) / (n_u + 1)
    lift = (rate - base) / np.sqrt(base * (1 / n_p + 1 / n_u))
    # prior * rate / base is the share of toxic texts among those with the feature.
    found = np.flatnonzero((p >= max(3, n_p // 100)) & (prior * rate >= SHARE * base) & (lift >= 4))
    return found[np.argsort(-lift[found], kind="stable")][:FEATURES]


def risk(xp: np.ndarray, xu: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(confirmed part, clean part, slope) of the non-negative risk at weights ``w``, whose last is the bias.

    Where the clean part is below zero, the slope is the one that steps back from it.
    """
    gp, gu = xp @ w[:-1].astype(np.float32) + w[-1], xu @ w[:-1].astype(np.float32) + w[-1]
    sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
    clean = float(np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean())
    # Slopes in g: of l(g) for confirmed texts, of l(-g) for both.
    hit, off_p, off_u = prior * (sp - 1) / len(gp), prior * sp / len(gp), su / len(gu)
    dp, du = (hit - off_p, off_u) if clean >= 0 else (off_p, -off_u)
    return float(prior * np.logaddexp(0, -gp).mean()), clean, np.r_[xp.T @ dp.astype(np.float32) + xu.T @ du.astype(np.float32), dp.sum() + du.sum()]


def train(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """(weights, bias) from the features of confirmed and unlabelled texts, 0 or 1."""
    w = np.zeros(xp.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = risk(xp, xu, w, prior)[2] + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:-1], float(w[-1])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(np.array([k for w in words_of(t) for k in keys_of(w)], np.int32)).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("confirmed"), pa.array(found, pa.binary())], names=["confirmed", "keys"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's confirmed and unlabelled texts each feature is."""
    p, u = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for confirmed, keys in zip(batch.column("confirmed").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            (p if confirmed else u)[np.frombuffer(keys, np.int32)] += 1
    at = np.flatnonzero(p)
    yield pa.record_batch([pa.array(at), pa.array(p[at]), pa.array(u[at])], names=["key", "p", "u"])
    at = np.flatnonzero((p == 0) & (u > 0))
    yield pa.record_batch([pa.array(at), pa.array(p[at]), pa.array(u[at])], names=["key", "p", "u"])


def _bits(place: np.ndarray, n: int):
    """Each text's features as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for keys in batch.column("keys").to_pylist():
                x = np.zeros(n, bool)
                own = place[np.frombuffer(keys, np.int32)]
                x[own[own >= 0]] = True
                found.append(np.packbits(x).tobytes())
            yield pa.record_batch([batch.column("confirmed"), pa.array(found, pa.binary())], names=["confirmed", "bits"])

    return run


NONE = Classifier({}, np.zeros(0), -30.0)


def learn(docs: DataFrame, labels: DataFrame, *, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> Classifier:
    """A classifier from documents (doc_id, text) and labels (doc_id, toxic) whose fold is not 0.

    Documents are drawn by the hash of their id, about ``positive`` confirmed and ``unlabelled`` others. Features are counted
    in the tasks; the driver gets the counts of those that reach the least count, and a bit a text for each feature chosen,
    whatever the texts' length. The prior is the share of toxic rows among the labels. Null ids and labels take no part.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").dropna().filter(fold(F.col("doc_id")) > 0)
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    pool = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(fold(F.col("doc_id")) > 0)
    rows = pool.count()
    if not n or not 0 < toxic < n or not rows:
        return NONE
    prior = toxic / n
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    ids = known.filter((F.col("toxic") == 1) & (draw < 1 + positive * 1_000_000 // toxic)).select("doc_id").distinct()
    confirmed = pool.join(F.broadcast(ids), "doc_id").withColumn("confirmed", F.lit(True))  # about ``positive`` ids
    others = pool.filter(F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1_000_000)) < 1 + unlabelled * 1_000_000 // rows).withColumn("confirmed", F.lit(False))
    drawn = cut(confirmed.unionByName(others).mapInArrow(_hashes, "confirmed boolean, keys binary"), "toxicity-drawn")
    n_p, n_u = (int(x or 0) for x in drawn.agg(F.count_if("confirmed"), F.count_if(~F.col("confirmed"))).first())
    if not n_p or not n_u:
        return NONE
    sums = drawn.mapInArrow(_totals, "key long, p long, u long").groupBy("key").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter(F.col("p") >= max(3, n_p // 100)).orderBy("key").toArrow()
    keys = sums["key"].to_numpy()
    chosen = keys[useful(sums["p"].to_numpy(), sums["u"].to_numpy(), n_p, n_u, prior)]
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    bits = drawn.mapInArrow(_bits(place, len(chosen)), "confirmed boolean, bits binary").collect()
    grid = lambda c: np.stack([np.unpackbits(np.frombuffer(b, np.uint8), count=len(chosen)) for b in sorted(bytes(r.bits) for r in bits if r.confirmed == c)]).astype(np.float32)
    weights, bias = train(grid(True), grid(False), prior)
    return Classifier({int(k): i for i, k in enumerate(chosen)}, weights, bias)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5, else 0).

    Only the text is an input of a score. Null texts count as empty and get the score of a text without any feature;
    without labels to learn from all scores are close to 0. A null doc_id is neither learned from nor held out. Repeated
    rows stay.
    """
    model = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
