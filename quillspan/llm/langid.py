"""Language ID by a linear-chain conditional random field over words.

Each word is a position, each language a label. Emissions come from hashed affix, n-gram, whole-word and lexicon features,
transitions are learned, and forward-backward gives every word's label probabilities, so code-switched text is labelled
word by word. A text's language is the one with the largest mean probability over its words with letters.

The model learns from a bounded sample of labelled windows of words. Windows of two languages are also joined, so that the
transitions between languages are learned from text that switches. Tasks hold parts of the sample; in each round they make
gradient steps from the model so far, and their weights are averaged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise
from unicodedata import category
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import PART as MODEL
from quillspan.llm.common import averaged, cut, fold, held, sliced

#: Labelled windows a language and in all to learn from, at most about, and words of a window.
WINDOWS, MOST, WINDOW = 1000, 40_000, 120
ROUNDS, PER_TASK = 5, 500  # rounds of fitting; windows of a task
BITS = 16
LEXICON = 200  # words a language
UNKNOWN = "und"
REMEMBERED = 200_000
PART = 1_500_000  # characters of texts that one pass takes on
CELLS = 300_000  # words of texts, padded, that it holds
STRIP = bytes(c for c in range(128) if not chr(c).isalpha())


def _mix(values: np.ndarray, tag: int) -> np.ndarray:
    return (((values + np.uint64(tag << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(cores: list[bytes], lexicon: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, value) of lower-cased, stripped words: the word, beginnings and endings of up to four bytes, its
    lexicon, and byte trigrams with the word's edges."""
    n = np.array([len(c) for c in cores], np.int64)
    raw = np.frombuffer(b"".join(b"^" + c + b"$" for c in cores), np.uint8).astype(np.uint64)
    start = np.cumsum(n + 2) - (n + 2)
    every = np.arange(len(cores))
    found = [(every, np.array([crc32(c) & ((1 << BITS) - 1) for c in cores], np.int64))]
    for k in (1, 2, 3, 4):
        own = every[n >= k]
        for tag, first in ((k, start[own] + 1), (8 + k, start[own] + 1 + n[own] - k)):
            v = np.zeros(len(own), np.uint64)
            for j in range(k):
                v |= raw[first + j] << np.uint64(8 * j)
            found.append((own, _mix(v, tag)))
    listed = [(i, lexicon[c]) for i, c in enumerate(cores) if c in lexicon]
    found.append((np.array([i for i, _ in listed], np.int64), _mix(np.array([x for _, x in listed], np.uint64), 20)))
    word = np.repeat(every, n)
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    grams = raw[at] | raw[at + 1] << np.uint64(8) | raw[at + 2] << np.uint64(16)
    rows = np.concatenate([w for w, _ in found] + [word])
    values = np.ones(len(rows), np.float32)
    values[len(rows) - len(word) :] = (1 / np.sqrt(np.maximum(n, 1)))[word]
    return rows, np.concatenate([f for _, f in found] + [_mix(grams, 30)]), values


def emit(weights: np.ndarray, n: int, rows: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the features' weights of each of ``n`` words, one language at a time."""
    return np.stack([np.bincount(rows, weights[ids, y] * values, n) for y in range(weights.shape[1])], 1).astype(np.float32)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def core_of(word: bytes) -> bytes:
    """The word from its first to its last letter, with the marks on these; empty without a letter."""
    core = word.strip(STRIP)
    if core.isascii():
        return core
    text = core.decode(errors="replace")
    if not any(map(str.isalpha, text)):
        return b""
    held = [i for i, c in enumerate(text) if c.isalpha() or category(c)[0] == "M"]
    return text[held[0] : held[-1] + 1].encode()


@dataclass
class Crf:
    languages: list[str]
    lexicon: dict[bytes, int]
    weights: np.ndarray  # features, languages
    moves: np.ndarray  # log potentials of the next label
    seen: dict[bytes, int] = field(default_factory=dict)
    emissions: np.ndarray | None = None

    def indices(self, words: list[bytes]) -> np.ndarray:
        """Rows of ``emissions`` for words; row 0 is for words without letters."""
        if self.emissions is None or len(self.seen) > REMEMBERED:
            self.seen, self.emissions, self.used = {}, np.zeros((1024, len(self.languages)), np.float32), 1
        seen = self.seen
        fresh = [w for w in dict.fromkeys(words) if w not in seen]
        if fresh:
            cores = [core_of(w) for w in fresh]
            seen.update(dict.fromkeys((w for w, c in zip(fresh, cores, strict=True) if not c), 0))
            real = [c for c in cores if c]
            if real:
                while self.used + len(real) > len(self.emissions):
                    self.emissions = np.concatenate([self.emissions, np.zeros_like(self.emissions)])
                self.emissions[self.used : self.used + len(real)] = emit(self.weights, len(real), *features(real, self.lexicon))
                seen.update(zip((w for w, c in zip(fresh, cores, strict=True) if c), range(self.used, self.used + len(real)), strict=True))
                self.used += len(real)
        return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, mean probability) of each text; (und, 0.0) for one without letters."""
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return found
        split = [words_of(t) for t in texts]
        flat = self.indices([w for words in split for w in words])
        sizes = np.array([len(w) for w in split])
        first = np.cumsum(sizes) - sizes
        order = [int(i) for i in np.argsort(-sizes, kind="stable") if sizes[i]]
        at = 0
        while at < len(order):
            most = int(sizes[order[at]])
            part = order[at : at + max(1, min(1024, CELLS // most))]
            at += len(part)
            grid = np.zeros((most, len(part)), np.int64)
            for j, i in enumerate(part):
                grid[: sizes[i], j] = flat[first[i] : first[i] + sizes[i]]
            total, n = posterior_sums(self.emissions[grid], grid > 0, sizes[part], self.moves)
            for j, i in enumerate(part):
                if n[j]:
                    p = total[j] / n[j]
                    found[i] = (self.languages[int(p.argmax())], float(min(1.0, max(0.0, p.max()))))
                elif any(c.isalpha() for c in texts[i]):  # letters inside words that the features strip: none known
                    found[i] = (self.languages[0], 1 / len(self.languages))
        return found


def forward_backward(emissions: np.ndarray, sizes: np.ndarray, moves: np.ndarray, paired: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
    """From the last position back: (position, rows alive, label probabilities, pair weights with the next position).

    ``emissions``: position, row, label; rows by falling ``sizes``. Pair weights only if ``paired``.
    """
    most, _, labels = emissions.shape
    alive = np.searchsorted(-sizes, -np.arange(1, most + 1), side="right")
    e = np.exp(emissions - emissions.max(2, keepdims=True))
    m = np.exp(moves - moves.max())
    ahead = np.empty_like(e)
    for t in range(most):
        b = alive[t]
        a = e[t, :b] if t == 0 else (ahead[t - 1, :b] @ m) * e[t, :b]
        ahead[t, :b] = a / a.sum(1, keepdims=True)
    back = np.ones((len(sizes), labels), e.dtype)
    for t in range(most - 1, -1, -1):
        b, later = alive[t], alive[t + 1] if t + 1 < most else 0
        pairs = None
        if later:
            came = e[t + 1, :later] * back[:later]
            if paired:
                pairs = ahead[t, :later, :, None] * m * came[:, None, :]
                pairs /= pairs.sum((1, 2), keepdims=True)
            came = came @ m.T
            back[:later] = came / came.sum(1, keepdims=True)
        p = ahead[t, :b] * back[:b]
        yield t, b, p / p.sum(1, keepdims=True), pairs


def posterior_sums(emissions: np.ndarray, lettered: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of label probabilities over the lettered words of each row, and how many these are."""
    total = np.zeros((len(sizes), emissions.shape[2]))
    for t, b, p, _ in forward_backward(emissions, sizes, moves, paired=False):
        total[:b] += p * lettered[t, :b, None]
    return total, lettered.sum(0)


def step(crf: Crf, samples: list[tuple[str, list[bytes]]], rate: float, seed: int) -> int:
    """One pass of Adagrad steps on the log-likelihood of (language, words) windows and of pairs of them, joined; changes the
    weights and returns the number of words."""
    label = {lang: i for i, lang in enumerate(crf.languages)}
    n = len(crf.languages)
    rng = np.random.default_rng(seed)
    joined = []
    for _ in range(len(samples) // 2):  # text that switches
        (la, a), (lb, b) = (samples[int(rng.integers(len(samples)))] for _ in range(2))
        a, b = a[: max(1, len(a) // 2)], b[len(b) // 2 :]
        joined.append((a + b, [label[la]] * len(a) + [label[lb]] * len(b)))
    sequences = [(w, [label[lang]] * len(w)) for lang, w in samples if w] + [s for s in joined if s[0]]
    kinds = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in sequences for w in words))}
    cores = [core_of(w) for w in kinds]
    real = [i for i, c in enumerate(cores) if c]
    rows, ids, values = features([cores[i] for i in real], crf.lexicon)
    order = np.argsort(rows, kind="stable")
    rows, ids, values = np.array(real, np.int64)[rows[order]], ids[order], values[order]
    ends = np.searchsorted(rows, np.arange(len(cores) + 1))
    flat = [ids[a:b] for a, b in pairwise(ends.tolist())]
    value = [values[a:b] for a, b in pairwise(ends.tolist())]
    grown, grown_moves = np.full_like(crf.weights, 1e-2), np.full_like(crf.moves, 1e-2)
    order = rng.permutation(len(sequences))
    for at in range(0, len(order), 32):
        batch = sorted((sequences[i] for i in order[at : at + 32]), key=lambda s: -len(s[0]))
        sizes = np.array([len(s[0]) for s in batch])
        ids = np.zeros((sizes[0], len(batch)), np.int64)
        gold = np.zeros((sizes[0], len(batch)), np.int64)
        for j, (words, labels) in enumerate(batch):
            ids[: sizes[j], j] = [kinds[w] for w in words]
            gold[: sizes[j], j] = labels
        real = np.arange(sizes[0])[:, None] < sizes
        own, back = np.unique(ids[real], return_inverse=True)
        every, values = np.concatenate([flat[i] for i in own]), np.concatenate([value[i] for i in own])
        row = np.repeat(np.arange(len(own)), [len(flat[i]) for i in own])
        emitted = np.zeros((len(own), n), np.float32)
        np.add.at(emitted, row, crf.weights[every] * values[:, None])
        emissions = np.zeros((*ids.shape, n), np.float32)
        emissions[real] = emitted[back]
        off = np.zeros_like(emissions)
        move = np.zeros((n, n))
        for t, b, p, pairs in forward_backward(emissions, sizes, crf.moves):
            off[t, :b] = p
            off[t, np.arange(b), gold[t, :b]] -= 1
            if pairs is not None:
                later = len(pairs)
                move += pairs.sum(0)
                np.add.at(move, (gold[t, :later], gold[t + 1, :later]), -1)
        by_word = np.zeros((len(own), n), np.float32)
        np.add.at(by_word, back, off[real])
        used, place = np.unique(every, return_inverse=True)
        slope = np.zeros((len(used), n), np.float32)
        np.add.at(slope, place, by_word[row] * values[:, None])
        slope = slope / len(batch) + 1e-4 * crf.weights[used]
        grown[used] += slope**2
        crf.weights[used] -= rate * slope / np.sqrt(grown[used])
        slope = move.astype(np.float32) / len(batch) + 1e-3 * crf.moves
        grown_moves += slope**2
        crf.moves -= rate * slope / np.sqrt(grown_moves)
    return sum(len(w) for w, _ in sequences)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One window of words a document, from a place that its id chooses."""
    for batch in batches:
        found = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            at = crc32(b"%d" % (doc_id or 0)) % max(1, len(words) - WINDOW + 1)
            found.append(b" ".join(words[at : at + WINDOW]))
        yield pa.record_batch([batch.column("lang"), batch.column("doc_id"), pa.array(found, pa.binary())], names=["lang", "doc_id", "words"])


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, stripped word)."""
    counts: Counter = Counter()
    for batch in batches:
        for lang, words in zip(batch.column("lang").to_pylist(), batch.column("words").to_pylist(), strict=True):
            counts.update((lang, c) for c in map(core_of, words.split()) if c)
    yield pa.record_batch([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["lang", "core", "n"])


def lexicon(windows: DataFrame, languages: list[str]) -> dict[bytes, int]:
    """The ``LEXICON`` words of each language that are most frequent and most its own, of those more its than any other's."""
    counts = windows.mapInArrow(_cores, "lang string, core binary, n long").groupBy("core", "lang").agg(F.sum("n").alias("n"))
    by_core = Window.partitionBy("core")
    scored = counts.withColumn("score", F.col("n") * F.pow(F.col("n") / F.sum("n").over(by_core), F.lit(4))).withColumn("place", F.row_number().over(by_core.orderBy(F.desc("n"), "lang")))
    listed = scored.filter("n >= 3 and place = 1").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("core")))).filter(F.col("rank") <= LEXICON)
    return {bytes(r.core): languages.index(r.lang) for r in listed.select("core", "lang").collect()}


def _passes(crf: Crf, rate: float, seed: int):
    """A task's part of a round: the changes of its weights over a pass over its windows."""

    def run(windows: pa.Table) -> pa.Table:
        rows = sorted(zip(*(windows.column(c).to_pylist() for c in ("doc_id", "lang", "words")), strict=True))
        samples = [(lang, words.split()) for _, lang, words in rows if words]
        own = Crf(crf.languages, crf.lexicon, crf.weights.copy(), crf.moves.copy())
        n = step(own, samples, rate, seed + windows.column("task")[0].as_py()) if samples else 0
        return pa.Table.from_batches([sliced(np.concatenate([(own.weights - crf.weights).ravel(), (own.moves - crf.moves).ravel()]), max(n, 1e-9))])

    return run


def learn(docs: DataFrame, windows: int = WINDOWS, rounds: int = ROUNDS) -> Crf:
    """A model from the documents (doc_id, text, lang) whose fold is not 0; rows with a null take no part.

    About ``windows`` documents a language, fewer where that is over ``MOST`` in all, chosen by the hash of their id, give one
    window each. Tasks learn from these; only counts, lexicons and averaged weights reach the driver.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter((fold(F.col("doc_id")) > 0) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    n = len(languages)
    crf = Crf(languages, {}, np.zeros((1 << BITS, max(1, n)), np.float32), np.zeros((n, n), np.float32))
    if n < 2:
        return crf
    windows = min(windows, max(1, MOST // n))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.create_map(*[x for lang, size in sizes.items() for x in (F.lit(lang), F.lit(min(1_000_000, 1 + windows * 1_000_000 // size)))])
    drawn = cut(known.filter(draw < share[F.col("lang")]).mapInArrow(_windows, "lang string, doc_id long, words binary"), "langid-windows")
    crf.lexicon = lexicon(drawn, languages)
    tasks = max(1, drawn.count() // PER_TASK)
    dealt = drawn.withColumn("task", F.pmod(F.xxhash64("doc_id", F.lit("task")), F.lit(tasks)))
    for k in range(rounds):
        # A group is a task's part, at most about ``PER_TASK`` windows; changes are mostly zero and pack well.
        values, _ = averaged(dealt.groupBy("task").applyInArrow(_passes(crf, 0.3 / (1 + 0.5 * k), 1000 * k), MODEL))
        if len(values):
            crf.weights, crf.moves = crf.weights + values[: crf.weights.size].reshape(crf.weights.shape), crf.moves + values[crf.weights.size :].reshape(n, n)
    return crf


def _judged(crf: Crf, batch: pa.RecordBatch) -> list[tuple[str, float]]:
    """Predictions of a batch's texts, a bounded part at a time."""
    found, part, size = [], [], 0
    for text in batch.column("text"):
        part.append(text.as_py())
        size += len(part[-1] or "")
        if size >= PART:
            found += crf.predict(part)
            part, size = [], 0
    return found + crf.predict(part) if part else found


def _predict(crf: Crf, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _judged(crf, batch)
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array([p[0] for p in found], pa.string()), pa.array([p[1] for p in found], pa.float64())], names=[*columns, "lang_pred", "score"])

    return run


def languages(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Only the text is an input of a prediction. Null texts and texts without a letter get ``und`` and score 0; so does
    every text when there is nothing to learn from. A null doc_id is in no fold: it is neither learned from nor held out.
    Repeated rows stay.
    """
    crf = crf or learn(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(crf, ["doc_id", "held_out"]), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, min_score: float = 0.35) -> DataFrame:
    """``docs`` without the rows whose language is unknown or has a score under ``min_score``; all columns stay.

    Null texts and texts without a letter are unknown; a null id or label only keeps a row from being learned from. Repeated
    rows and equal texts share one fate; an empty table gives an empty result, and without labels no row is known.
    """
    crf = learn(docs)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held(batches):
            found = _judged(crf, batch)
            yield batch.filter(pa.array([lang != UNKNOWN and s >= min_score for lang, s in found], pa.bool_()))

    return docs.mapInArrow(run, schema)
