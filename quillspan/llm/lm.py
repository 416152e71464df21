"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) * P(unit | class, history) * P(token | unit). Two softmaxes over hashed n-gram and
skip features of the tokens before: the class from the last classes, skipped ones, the last word and a skipped word; the
unit within its class from the class with the last word, a skipped word and the last two classes. A frequent word is a unit
of its own; other words share the unit of their ending, and there a word has its smoothed share of the training tokens.
Classes are clusters of units with like neighbours, so they follow language and style.

Counts of words and of neighbours cover every training text and stay distributed. The ``TOP`` most frequent words, a bounded
table, go to all tasks; a text's other words are looked up by a join. Only the softmaxes' tables of weights are bounded: they
are fitted on every training text. In each round every task makes gradient steps over its own texts, as many tasks as the
texts have partitions, and the tasks' changes are averaged by slices of the weights, weighted by their tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import PART, averaged, cut, fold, sliced

#: Words that all tasks know, at most; rounds of fitting.
TOP, ROUNDS = 200_000, 1
#: Units: the most frequent words on their own, others by a hash of their ending; hashed neighbours.
OWN, ENDINGS, NEIGHBOURS = 2000, 512, 64
GROUPS, MEMBERS = 16, 64  # clusters of units; units of a class, at most: larger clusters are several classes
BITS = 14  # rows of each softmax's weights
OFTEN = 24  # tokens of a step from which a row of the weights is summed on its own
END = b""  # the end of a text, which no word equals
FLUSH = 400_000  # different words that a counting task holds


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _ending(word: bytes) -> int:
    return crc32(word[-3:]) % ENDINGS


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for raw in batch.column("text").cast(pa.binary()).to_pylist():
            counts.update((raw or b"").lower().split())
            counts[END] += 1
            if len(counts) > FLUSH:
                yield out(counts)
                counts = Counter()
    if counts:
        yield out(counts)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``docs``; the word ``END`` counts the texts."""
    return docs.select("text").mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, top: int = TOP) -> list[tuple[bytes, int]]:
    """The most frequent words with their counts, most frequent first, ``top`` at most, and always ``END``."""
    level = F.floor(F.log(F.col("n").cast("double")) * 32).cast("int")
    sizes = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = 1 << 30, 0
    for own, n in sizes:
        total += n
        if total > top:
            break
        least = own
    found = counts.filter((level >= least) | (F.col("word") == F.lit(END))).toArrow()
    return sorted(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


@dataclass
class Model:
    """What every task knows: bounded by ``TOP`` words and the size of the softmaxes."""

    ids: dict[bytes, int]  # the frequent words
    n: np.ndarray  # their counts
    unit_of: np.ndarray  # their units
    unit_class: np.ndarray  # classes of units: OWN words, then ENDINGS
    unit_member: np.ndarray  # places of units in their class
    unit_n: np.ndarray  # training tokens and different words of each unit
    unit_v: np.ndarray
    weights: np.ndarray  # rows, classes
    bias: np.ndarray
    inner: np.ndarray  # rows, members: first a row for each class, then hashed ones
    tokens: int
    words: int

    def units(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: its id (-1 if it is not frequent) and its unit."""
        ids = np.fromiter(map(self.ids.get, words, [-1] * len(words)), np.int64, len(words))
        units = np.r_[self.unit_of, 0][ids]
        rest = np.flatnonzero(ids < 0)
        units[rest] = [OWN + _ending(words[i]) for i in rest.tolist()]
        return ids, units

    def rows(self, units: np.ndarray, marks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of both softmaxes' weights for each token."""
        return features(self.unit_class[units], marks, first, len(self.bias))


def features(classes: np.ndarray, marks: np.ndarray, first: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weights for each token: of the classes' softmax (tokens, 6) and of the units' (tokens, 4).

    ``first``: where texts start; ``marks``: numbers of the words; ``none``: the class of what stands before a text.
    """
    n = len(classes)
    at = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))

    def before(x: np.ndarray, k: int, none: int) -> np.ndarray:
        return np.where(at >= k, np.r_[np.full(min(k, n), none), x[: max(0, n - k)]], none)

    c1, c2, c3 = (before(classes, k, none) for k in (1, 2, 3))
    w1, w2 = (before(marks, k, -1) for k in (1, 2))
    mask = np.uint64((1 << BITS) - 1)

    def row(kind: int, *x: np.ndarray) -> np.ndarray:
        h = np.full(len(x[0]), kind * 0x9E3779B9 + 1, np.uint64)
        for v in x:
            h = (h ^ v.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h & mask).astype(np.int64)

    every = np.arange(none + 1)  # rows of classes and of pairs of them come from tables
    of_one = lambda kind, c: row(kind, every)[c]
    of_two = row(2, np.repeat(every, none + 1), np.tile(every, none + 1))[c1 * (none + 1) + c2]
    outer = np.stack([of_one(1, c1), of_two, of_one(3, c2), of_one(4, c3), row(5, w1), row(6, w2)], 1)
    inner = np.stack([classes, *(none + row(kind, classes, *x) for kind, *x in ((11, w1), (12, w2), (14, c1, c2)))], 1)
    return outer, inner


class Shares:
    """Softmax over sums of rows of weights, in two buffers that every batch reuses."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, batch: int):
        self.weights, self.bias = weights, bias
        self.sums, self.row = (np.empty((batch, weights.shape[1]), np.float32) for _ in range(2))

    def sums_of(self, rows: np.ndarray) -> np.ndarray:
        """The sums for each token, less the largest of each; valid until the next call."""
        z, row = self.sums[: len(rows)], self.row[: len(rows)]
        np.take(self.weights, rows[:, 0], axis=0, out=z, mode="clip")
        z += self.bias
        for k in range(1, rows.shape[1]):
            z += np.take(self.weights, rows[:, k], axis=0, out=row, mode="clip")
        z -= z.max(1, keepdims=True)
        return z

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The probabilities for each token; valid until the next call."""
        z = self.sums_of(rows)
        np.exp(z, out=z)
        z /= np.einsum("ij->i", z)[:, None]
        return z

    def logs(self, rows: np.ndarray, gold: np.ndarray) -> np.ndarray:
        """The log probability of each token's ``gold``."""
        z = self.sums_of(rows)
        own = z[np.arange(len(gold)), gold]
        return own - np.log(np.einsum("ij->i", np.exp(z, out=z)))


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = Shares(weights, bias, len(rows)).sums_of(rows)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def gold_logs(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, classes: np.ndarray, batch: int = 2048) -> np.ndarray:
    """The log probability of each token's class, or unit in its class."""
    found, shares = np.empty(len(classes)), Shares(weights, bias, batch)
    for a in range(0, len(classes), batch):
        found[a : a + batch] = shares.logs(rows[a : a + batch], classes[a : a + batch])
    return found


def row_sums(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weights that tokens use, and the sums of ``g`` over the tokens of each, the most used first."""
    flat = rows.ravel().astype(np.uint16)
    order = np.argsort(flat, kind="stable")
    flat, token = flat[order], order // rows.shape[1]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    size = np.diff(np.r_[start, len(flat)])
    by_size = np.argsort(-size, kind="stable")
    start, size = start[by_size], size[by_size]
    sums = np.take(g, token[start], axis=0)
    often = int(np.searchsorted(-size, -OFTEN, side="right"))
    for i in range(often):
        sums[i] = np.take(g, token[start[i] : start[i] + size[i]], axis=0).sum(0)
    for k in range(1, int(size[often]) if often < len(size) else 1):
        upto = int(np.searchsorted(-size, -k, side="left"))
        sums[often:upto] += np.take(g, token[start[often:upto] + k], axis=0)
    return flat[start].astype(np.int64), sums


class Steps:
    """Adagrad steps over tokens in order, from given weights and bias, which stay as they are."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights.copy(), bias.copy()
        self.grown, self.grown_bias = np.full(len(weights), 1e-1, np.float32), np.full_like(bias, 1e-1)

    def run(self, rows: np.ndarray, classes: np.ndarray, rate: float, batch: int = 4096, free: bool = True) -> None:
        """``free``: the bias takes steps too."""
        shares = Shares(self.weights, self.bias, batch)
        for a in range(0, len(classes), batch):
            own, gold = rows[a : a + batch], classes[a : a + batch]
            g = shares.of(own)
            g[np.arange(len(gold)), gold] -= 1
            used, step = row_sums(own, g)
            step /= np.float32(32)
            self.grown[used] += np.einsum("ij,ij->i", step, step) / np.float32(step.shape[1])
            step *= (np.float32(rate) / np.sqrt(self.grown[used]))[:, None]
            self.weights[used] -= step
            if not free:
                continue
            step = g.sum(0) / np.float32(32)
            self.grown_bias += step**2
            self.bias -= rate * step / np.sqrt(self.grown_bias)


def _tokens(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """All tokens, ends of texts included, and where texts start."""
    flat: list[bytes] = []
    first = []
    for t in texts:
        first.append(len(flat))
        flat += words_of(t)
        flat.append(END)
    return flat, np.array(first, np.int64)


def _parts(batches: Iterator[pa.RecordBatch], chars: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of batches of about so many characters."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        a = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= chars or i + 1 == len(texts):
                yield batch.slice(a, i + 1 - a), texts[a : i + 1]
                a, size = i + 1, 0


def _codes(model: Model):
    """A row for each text, with a number: its tokens as numbers of four bytes, the id of a frequent word or -2 less the unit of
    another, and these other words for the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch, texts in _parts(batches):
            words, first = _tokens(texts)
            ids, units = model.units(words)
            marks = np.where(ids >= 0, ids, -2 - units).astype("<i4")
            ends = np.r_[first, len(words)].astype(np.int32)
            rest = np.flatnonzero(ids < 0)
            cuts = np.searchsorted(rest, ends).astype(np.int32)
            columns = [
                pa.array(rid + np.arange(len(texts))),
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends * 4), pa.py_buffer(marks)]),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array([words[i] for i in rest.tolist()], pa.binary())),
            ]
            rid += len(texts)
            yield pa.record_batch(columns, names=["rid", "doc_id", "held_out", "marks", "rest"])

    return run


def _coded(batches: Iterator[pa.RecordBatch], unit_of: np.ndarray, tokens: int = 200_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, marks, units, where texts start) of slices of batches of about so many tokens."""
    known = np.r_[unit_of, 0]
    for batch in batches:
        texts = batch.column("marks").to_pylist()
        a = size = 0
        for i, t in enumerate(texts):
            size += len(t) // 4
            if size >= tokens or i + 1 == len(texts):
                marks = np.frombuffer(b"".join(texts[a : i + 1]), "<i4").astype(np.int64)
                sizes = np.array([len(x) // 4 for x in texts[a : i + 1]])
                yield batch.slice(a, i + 1 - a), marks, np.where(marks >= 0, known[np.maximum(marks, -1)], -2 - marks), np.cumsum(sizes) - sizes
                a, size = i + 1, 0


def _neighbours(unit_of: np.ndarray):
    """Counts of (unit, hashed unit beside it) over a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((OWN + ENDINGS) * 2 * NEIGHBOURS, np.int64)
        for _, _, unit, _ in _coded(batches, unit_of):
            beside = (unit * 2654435761 >> 7) % NEIGHBOURS
            total += np.bincount(unit[:-1] * 2 * NEIGHBOURS + beside[1:], minlength=len(total))
            total += np.bincount(unit[1:] * 2 * NEIGHBOURS + NEIGHBOURS + beside[:-1], minlength=len(total))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 50_000):
            yield pa.record_batch([pa.array(at[i : i + 50_000]), pa.array(total[at[i : i + 50_000]])], names=["cell", "n"])

    return run


def cluster(table: np.ndarray, sizes: np.ndarray, groups: int, rounds: int = 12) -> np.ndarray:
    """K-means of the rows' shares, weighted by the roots of their sizes; rows without counts go to group 0."""
    x = np.sqrt(table / np.maximum(1, table.sum(1, keepdims=True)))
    weight = np.sqrt(sizes)
    rng = np.random.default_rng(0)
    centres = x[[int(np.argmax(sizes))]]
    for _ in range(min(groups, len(x)) - 1):
        far = ((x[:, None] - centres[None]) ** 2).sum(2).min(1) * weight
        if far.sum() <= 0:
            break
        centres = np.concatenate([centres, x[[int(rng.choice(len(x), p=far / far.sum()))]]])
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        for g in range(len(centres)):
            own = label == g
            if weight[own].sum() > 0:
                centres[g] = np.average(x[own], axis=0, weights=weight[own])
    return label


def _changes(model: Model, rate: float):
    """A task's part of a round: its changed weights by slices, with its number of tokens."""
    weights, bias, inner, unit_of, unit_class, unit_member = model.weights, model.bias, model.inner, model.unit_of, model.unit_class, model.unit_member

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, within, n = Steps(weights, bias), Steps(inner, np.zeros(MEMBERS, np.float32)), 0
        for _, marks, units, first in _coded(batches, unit_of):
            classes = unit_class[units]
            outer_rows, inner_rows = features(classes, marks, first, len(bias))
            steps.run(outer_rows, classes, rate)
            within.run(inner_rows, unit_member[units], rate, free=False)
            n += len(marks)
        if n:
            yield sliced(np.concatenate([steps.weights.ravel(), steps.bias, within.weights.ravel()]), n)

    return run


def fit_round(codes: DataFrame, model: Model, rate: float) -> float:
    """One round over all texts of ``codes``: the model takes the averaged weights; returns the number of tokens seen."""
    joined, tokens = averaged(codes.mapInArrow(_changes(model, rate), PART))
    outer, bias, inner = np.split(joined, [model.weights.size, model.weights.size + model.bias.size])
    model.weights, model.bias, model.inner = outer.reshape(model.weights.shape).copy(), bias.copy(), inner.reshape(model.inner.shape).copy()
    return tokens


def _unit_totals(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(OWN + ENDINGS), np.zeros(OWN + ENDINGS)
        for batch in batches:
            units = model.units(batch.column("word").to_pylist())[1]
            n += np.bincount(units, batch.column("n").to_numpy(), minlength=len(n))
            v += np.bincount(units, minlength=len(v))
        at = np.flatnonzero(v)
        yield pa.record_batch([pa.array(at), pa.array(n[at].astype(np.int64)), pa.array(v[at].astype(np.int64))], names=["unit", "n", "v"])

    return run


def classes_of(labels: np.ndarray, sizes: np.ndarray, most: int = MEMBERS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of units and places in them, from clusters: one of more than ``most`` units is cut, the frequent ones first."""
    classes, members, n = np.zeros(len(labels), np.int64), np.zeros(len(labels), np.int64), 0
    for label in np.unique(labels):
        own = np.flatnonzero(labels == label)
        own = own[np.argsort(-sizes[own], kind="stable")]
        classes[own], members[own] = n + np.arange(len(own)) // most, np.arange(len(own)) % most
        n += -(-len(own) // most)
    return classes, members


def train(docs: DataFrame, *, top: int = TOP, fitted: int | None = None, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """A model from all rows of ``docs`` (doc_id, text), and the distributed counts of its words.

    ``fitted``: for trials, about how many texts the classes and the softmax learn from; without it, from all.
    """
    return _learned(docs.select("doc_id", F.lit(False).alias("held_out"), "text"), top, fitted, rounds)[:2]


def _learned(rows: DataFrame, top: int, fitted: int | None, rounds: int) -> tuple[Model, DataFrame, DataFrame]:
    """A model from the rows (doc_id, held_out, text) that are not held out, the counts of their words, and all rows' codes:
    each text is cut into tokens once to count, of the rows learned from, and once for its codes."""
    counts = cut(word_counts(rows.filter("not held_out")), "lm-counts")
    tokens, words = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    known = frequent(counts, top)
    ids = {w: i for i, (w, _) in enumerate(known)}
    units = OWN + ENDINGS
    unit_of = np.array([i if i < OWN else OWN + _ending(w) for i, (w, _) in enumerate(known)], np.int64)
    classes, members = classes_of(np.zeros(units, np.int64), np.zeros(units))
    c = int(classes.max()) + 1
    model = Model(ids, np.array([n for _, n in known], np.int64), unit_of, classes, members, np.zeros(units), np.zeros(units), np.zeros((1 << BITS, c), np.float32), np.zeros(c, np.float32), np.zeros((c + (1 << BITS), MEMBERS), np.float32), tokens, words)
    every = cut(rows.mapInArrow(_codes(model), "rid long, doc_id long, held_out boolean, marks binary, rest array<binary>"), "lm-codes", compression="zstd")
    ends = ids and counts.filter(F.col("word") == F.lit(END)).select("n").first()[0]
    if not ends:
        return model, counts, every
    codes = every.filter("not held_out")
    if fitted is not None:
        draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit("fit")), F.lit(1_000_000))
        codes = codes.filter(draw < 1 + fitted * 1_000_000 // ends)
    codes = codes.select("marks")
    cells = codes.mapInArrow(_neighbours(model.unit_of), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(units * 2 * NEIGHBOURS)
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    table = table.reshape(units, -1)
    sizes = table[:, :NEIGHBOURS].sum(1)
    for r in counts.mapInArrow(_unit_totals(model), "unit long, n long, v long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        model.unit_n[r.unit], model.unit_v[r.unit] = r.n, r.v
    model.unit_class, model.unit_member = classes_of(cluster(table, sizes, GROUPS), model.unit_n)
    c = int(model.unit_class.max()) + 1
    model.weights = np.zeros((1 << BITS, c), np.float32)
    model.bias = np.log((np.bincount(model.unit_class, model.unit_n, c) + 1) / (tokens + c)).astype(np.float32)
    model.inner = np.zeros((c + (1 << BITS), MEMBERS), np.float32)
    model.inner[:c] = -30  # places without a unit
    model.inner[model.unit_class, model.unit_member] = np.log(model.unit_n + 1)
    model.inner[:c] -= np.log(np.exp(model.inner[:c].astype(np.float64)).sum(1, keepdims=True)).astype(np.float32)
    for k in range(rounds):
        fit_round(codes, model, 0.1 / (1 + k))
    return model, counts, every


def _scores(model: Model):
    """A text's sums over what all tasks know; its other words' log10(c + 0.5) come by the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.r_[model.n, 0]
        whole = np.log10(model.tokens + 0.5 * (model.words + 1))
        share = np.r_[np.log10(model.n + 0.5), 0.0]  # the last is that of words to be joined
        in_unit = np.where(np.r_[model.unit_of, OWN] < OWN, 0.0, share)  # a frequent word is all of its unit
        part = np.log10(model.unit_n + 0.5 * (model.unit_v + 1))
        part[:OWN] = 0.0
        none = np.zeros(MEMBERS, np.float32)
        for rows, marks, units, first in _coded(batches, model.unit_of):
            ids = np.maximum(marks, -1)
            outer, inner = model.rows(units, marks, first)
            logs = gold_logs(model.weights, model.bias, outer, model.unit_class[units]) + gold_logs(model.inner, none, inner, model.unit_member[units])
            columns = [
                *(rows.column(c) for c in ("rid", "doc_id", "held_out")),
                pa.array(np.diff(np.r_[first, len(marks)])),
                pa.array(np.add.reduceat((ids >= 0) & (n[ids] > 0), first, dtype=np.int64)),
                pa.array(np.add.reduceat(share[ids] - whole, first)),
                pa.array(np.add.reduceat(in_unit[ids] + logs / np.log(10) - part[units], first)),
            ]
            yield pa.record_batch(columns, names=["rid", "doc_id", "held_out", "n_tokens", "known", "base", "sum"])

    return run


def score(docs: DataFrame, *, top: int = TOP, fitted: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are not read): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    Texts whose fold is 1 are held out; the others, those without an id too, are learned from. Null texts count as empty:
    their one token is the end. Repeated rows stay and count each. Without training texts every token is unknown. The
    score is log10 of the model's probability of the text and its end, base_score that of its tokens' smoothed shares.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    model, counts, codes = _learned(rows, top, fitted, rounds)
    found = cut(codes.drop("rest").mapInArrow(_scores(model), "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, sum double"), "lm-scores", compression="zstd")
    rest = codes.select("rid", F.explode("rest").alias("word")).join(counts, "word", "left")
    sums = rest.groupBy("rid").agg(F.sum(F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.5))).alias("more"), F.count("n").alias("more_known"))
    zero = F.lit(0)
    return found.join(sums, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
