"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, and a scan of the documents' windows.

Spark makes the *pairs* of a window (ten consecutive words of an item, or all words of a shorter one) and its item. A hash
set of them goes to every task: each word of the benchmark has a number, a window is the polynomial hash of its words'
numbers. A task numbers the words of a text (0: no word of the benchmark), hashes all its windows in arrays, looks them up
and verifies each hit by comparing the words' numbers.

The set's size is checked before it is sent. A larger benchmark is cut by hash into slices of that size; every slice scans
the documents, reports only what it hits, and the reports of a text are put together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.common import cut
from quillspan.llm.words import PLAIN, word_pieces, words

#: Pairs, and bytes of their windows and items, of one broadcast set.
PAIRS, BYTES = 200_000, 32_000_000
#: Words of texts whose windows are hashed together.
TOGETHER = 1 << 20

SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
HITS = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def window_pairs(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct (window, item) of ``benchmark`` (item_id, text): words joined by a space, ids as text; a null id is ''."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words("text").alias("words")).filter("size(words) > 0")
    size = F.least(F.size("words"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    return items.withColumn("size", size).select("item", F.explode(F.transform(starts, lambda at: F.array_join(F.slice("words", at, F.col("size")), " "))).alias("window")).distinct()


class WindowSet:
    """A hash set of windows with their items. ``hits`` finds and verifies them in many texts at once."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.number: dict[bytes, int] = {}
        by_size: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for window, item in pairs:
            own = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window.encode().split(b" "))
            by_size.setdefault(len(own), {}).setdefault(own, []).append(item)
        for seed in range(100):  # until no two windows share a hash
            rng = np.random.default_rng(seed)
            self.values = rng.integers(0, 1 << 63, len(self.number) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            self.base = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
            self.sizes = [self._table(size, own) for size, own in sorted(by_size.items())]
            if all(len(np.unique(hashes)) == len(hashes) for _, hashes, _, _, _ in self.sizes):
                return
        raise ValueError("windows share hashes under every seed")

    def _table(self, size: int, own: dict[tuple[int, ...], list[str]]) -> tuple:
        """(size, sorted hashes, the windows' numbers, their items, marks of the hashes' leading bits)."""
        rows = np.array(list(own), np.int32)
        hashes = self._rolled(rows, size)[:, 0]
        order = np.argsort(hashes)
        items = list(own.values())
        bits = max(10, (len(rows) * 16).bit_length())
        marks = np.zeros(1 << bits, bool)
        marks[hashes >> np.uint64(64 - bits)] = True
        return size, hashes[order], rows[order], [items[i] for i in order], marks

    def _rolled(self, numbers: np.ndarray, size: int) -> np.ndarray:
        """The hash of each run of ``size`` numbers along the last axis."""
        values = self.values[numbers]
        last = values.shape[-1] - size + 1
        found = np.zeros((*values.shape[:-1], last), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size):
                found = found * self.base + values[..., j : j + last]
        return found

    def numbered(self, raw: bytes) -> np.ndarray:
        """The number of each word of a text, 0 for words that no item has."""
        pieces = [np.fromiter(map(self.number.get, piece, repeat(0)), np.int32, len(piece)) for piece in word_pieces(raw)]
        return np.concatenate(pieces) if pieces else np.zeros(0, np.int32)

    def hits(self, texts: list[np.ndarray]) -> list[tuple[list[tuple[int, int]], list[str]]]:
        """For each text, given as numbers: the runs of hit words (first, last), and the items in the order of their names."""
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        numbers = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        edges = np.zeros(len(numbers) + 1, np.int32)
        items: dict[int, set[str]] = {}
        for size, hashes, rows, names, marks in self.sizes:
            if len(numbers) < size:
                continue
            rolled = self._rolled(numbers, size)
            bits = len(marks).bit_length() - 1
            at = np.flatnonzero(marks[rolled >> np.uint64(64 - bits)])
            place = np.minimum(np.searchsorted(hashes, rolled[at]), len(hashes) - 1)
            same = hashes[place] == rolled[at]
            at, place = at[same], place[same]
            text = np.searchsorted(ends, at, "right")
            inside = at + size <= ends[text]
            at, place, text = at[inside], place[inside], text[inside]
            for j in range(size):  # compares the words themselves
                if not (good := numbers[at + j] == rows[place, j]).all():
                    at, place, text = at[good], place[good], text[good]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + size, -1)
            for t, p in set(zip(text.tolist(), place.tolist(), strict=True)):
                items.setdefault(t, set()).update(names[p])
        found: list[tuple[list[tuple[int, int]], list[str]]] = [([], []) for _ in texts]
        hit = np.cumsum(edges)[:-1] > 0
        for t, own in items.items():
            flags = np.diff(hit[starts[t] : ends[t]].astype(np.int8), prepend=0, append=0)
            found[t] = (list(zip(np.flatnonzero(flags == 1).tolist(), (np.flatnonzero(flags == -1) - 1).tolist(), strict=True)), sorted(own))
        return found


def _scan(table: Broadcast, text_at: int, columns: list[str], every: bool) -> Callable:
    """A pass over Arrow batches to ``columns``: those of the batch, and the three of ``HITS``; rows without a hit only if
    ``every``."""
    kept = len(columns) - len(HITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: WindowSet = table.value

        def done(batch: pa.RecordBatch, first: int, texts: list[np.ndarray]) -> pa.RecordBatch:
            found = windows.hits(texts)
            some = [i for i, (spans, _) in enumerate(found) if every or spans]
            own = batch.slice(first, len(texts)).take(pa.array(some, pa.int64()))
            more = [pa.array([len(texts[i]) for i in some], pa.int64()), pa.array([[{"first": a, "last": b} for a, b in found[i][0]] for i in some], _SPAN), pa.array([found[i][1] for i in some], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(own.columns[:kept] + more, names=columns)

        for batch in batches:
            texts: list[np.ndarray] = []
            first = held = 0
            for i, raw in enumerate(batch.column(text_at).cast(pa.binary())):
                own = windows.numbered(raw.as_py() or b"")
                texts.append(own)
                held += len(own) + 1
                if held >= TOGETHER:
                    yield done(batch, first, texts)
                    first, held, texts = i + 1, 0, []
            if texts:
                yield done(batch, first, texts)

    return run


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def _marked(docs: DataFrame, columns: list[str], benchmark: DataFrame, n: int, pairs: int, size: int) -> tuple[DataFrame, dict[str, str]]:
    """``columns`` of ``docs`` with those of ``HITS``, and the names that these have there."""
    if n < 1:
        raise ValueError(f"a window needs a word, not {n}")
    spark = docs.sparkSession
    every = cut(window_pairs(benchmark, n), "benchmark-windows")
    count, octets = every.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0))).first()
    slices = max(1, -(-count // pairs), -(-octets // size))
    # By hash of both, so that a window that all items share is cut too; a slice is a little larger than its share at most.
    part = F.pmod(F.xxhash64("window", "item"), F.lit(slices))

    def sent(k: int) -> Broadcast:
        return spark.sparkContext.broadcast(WindowSet([(r.window, r.item) for r in every.filter(part == k).collect()]))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = {f.name: _free(docs, f.name) for f in HITS}
    own = [F.col(f"`{c}`") for c in columns]
    if slices == 1:
        rows = docs.select(*own) if "text" in columns else docs.select(*own, text.alias("text"))
        schema = T.StructType([*docs.select(*own).schema.fields, *(T.StructField(names[f.name], f.dataType) for f in HITS)])
        return rows.mapInArrow(_scan(sent(0), rows.columns.index("text"), schema.names, True), schema), names
    keyed = docs.select(F.sha2(text.cast("binary"), 256).alias("key"), text.alias("text"))
    schema = T.StructType([T.StructField("key", T.StringType()), *HITS])
    reports = None
    for k in range(slices):  # each slice is read, sent and used up by itself
        table = sent(k)
        found = cut(keyed.mapInArrow(_scan(table, 1, schema.names, False), schema), "benchmark-hits")
        table.unpersist()
        reports = found if reports is None else reports.unionByName(found)
    # Equal texts have equal reports; the spans of all slices are merged where they meet.
    merged = """aggregate(array_sort(array_distinct(flatten(collect_list(spans)))), cast(array() as array<struct<first:bigint,last:bigint>>),
      (m, s) -> if(size(m) > 0 and s.first <= element_at(m, -1).last + 1,
                   concat(slice(m, 1, size(m) - 1), array(named_struct('first', element_at(m, -1).first, 'last', greatest(element_at(m, -1).last, s.last)))),
                   concat(m, array(s))))"""
    reports = reports.groupBy(F.col("key").alias("hit_key")).agg(F.expr(merged).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("hit_items"))
    joined = docs.join(reports, F.sha2(text.cast("binary"), 256) == reports["hit_key"], "left")
    more = [F.size(words("text")).cast("long"), F.coalesce(reports["hit_spans"], F.from_json(F.lit("[]"), SPANS)), F.coalesce(reports["hit_items"], F.from_json(F.lit("[]"), T.ArrayType(T.StringType())))]
    return joined.select(*[docs[f"`{c}`"] for c in columns], *[c.alias(names[f.name]) for c, f in zip(more, HITS, strict=True)]), names


def contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, pairs: int = PAIRS, size: int = BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of ``docs`` (doc_id, text; other columns are not read).

    ``spans``: runs of hit words, from word ``first`` to word ``last`` (counted from 0), which neither touch nor overlap; a word
    is hit if any occurrence of a window of ``benchmark`` (item_id, text) covers it. ``items``: the ids of the items with such a
    window, as text, distinct and sorted; a null id is ''. Null and empty texts have no words and no windows; items of fewer
    than ``n`` words are one window. Repeated rows, ids and texts on either side stay as they are; empty tables give no hits or
    an empty result. ``pairs`` and ``size`` bound a broadcast set; a larger benchmark is scanned in slices, with equal results.
    """
    found, names = _marked(docs.select("doc_id", "text"), ["doc_id"], benchmark, n, pairs, size)
    return found.select("doc_id", *names.values())


def _without(raw: bytes, spans: list[dict]) -> bytes:
    """``raw`` without the bytes from the first to the last word of each span."""
    inside = np.frombuffer(raw.translate(PLAIN), np.uint8) != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, last = edges[::2], edges[1::2]
    kept, at = [], 0
    for span in spans:
        kept.append(raw[at : first[span["first"]]])
        at = int(last[span["last"]])
    return b"".join([*kept, raw[at:]])


def _cut_spans(text_at: int, spans_at: int, columns: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at)
            changed = [t.as_py() if not len(s.values) else _without(t.as_py().encode(), s.as_py()).decode() for t, s in zip(texts, batch.column(spans_at), strict=True)]
            own = [pa.array(changed, texts.type) if c == text_at else batch.column(c) for c in range(columns)]
            yield pa.RecordBatch.from_arrays(own, names=batch.schema.names[:columns])

    return run


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, pairs: int = PAIRS, size: int = BYTES) -> DataFrame:
    """``docs``, all rows and columns, with hit words taken out of ``text`` (a string): each run of them from its first
    character to its last, what separates its words included. Other characters, and null texts, stay as they are. Rows are
    as in ``contamination``."""
    found, names = _marked(docs, docs.columns, benchmark, n, pairs, size)
    found = found.select(*[F.col(f"`{c}`") for c in docs.columns], names["spans"])
    return found.mapInArrow(_cut_spans(docs.columns.index("text"), len(docs.columns), len(docs.columns)), docs.schema)


def remove_documents(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, least: float = 0.0, pairs: int = PAIRS, size: int = BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose share of hit words is ``least`` or less; as in ``contamination`` otherwise."""
    found, names = _marked(docs, docs.columns, benchmark, n, pairs, size)
    hit = F.aggregate(names["spans"], F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"] + 1)
    return found.filter(hit <= F.col(names["n_words"]) * F.lit(float(least))).select(*[F.col(f"`{c}`") for c in docs.columns])
