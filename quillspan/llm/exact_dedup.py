"""Exact dedup by an extendible-hash index on shared files.

1. Tasks over the documents write *entries*: one row a document with its key, and the normalised bytes once for each
   different text of a batch (copies inside a batch are compared and counted there, so a text that fills a third of all
   rows reaches its owner once a batch).
2. The *directory* maps the leading bits of a key to a bucket. It starts with one bucket; a bucket over its capacity is
   split by one more bit, and the directory doubles when a bucket needs more bits than the directory has.
3. The *owner* of a bucket reads its entries in key order. It chains the different texts of a key, comparing bytes, and
   yields one row a text: who stays, and how many there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import SPACES, cut

#: Leading key bits that the directory may use at most: 65,536 cells, whatever the input.
MAX_DEPTH = 16
#: Texts of a bucket beyond which it is split.
CAPACITY = 4096

_ENTRY = "rid long, doc_id long, n_chars long, key long, sha string, norm binary, n long, best_chars long, best_id long, best_rid long"
_GROUP = "key long, sha string, group_size long, keep_id long, keep_chars long, keep_rid long"

Best = tuple[int, bool, int, int]


def sha_key(norm: bytes, sha: bytes) -> int:
    """The key of a text: the first eight bytes of its SHA-256, as a signed number."""
    return int.from_bytes(sha[:8], "big", signed=True)


def _rank(n_chars: int, doc_id: int | None, rid: int) -> Best:
    """Sorts the row that stays first: most code points, then smallest id (null last), then first row."""
    return (-n_chars, doc_id is None, doc_id or 0, rid)


def _entries(key_of: Callable[[bytes, bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("key", pa.int64()), ("sha", pa.string()), ("norm", pa.binary()), ("n", pa.int64()), ("best_chars", pa.int64()), ("best_id", pa.int64()), ("best_rid", pa.int64())])
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            lengths = pc.utf8_length(text).to_pylist()
            ids = batch.column("doc_id").to_pylist()
            seen: dict[bytes, list] = {}
            rows = []
            for doc_id, n_chars, raw in zip(ids, lengths, text.cast(pa.binary()).to_pylist(), strict=True):
                norm = raw.translate(None, SPACES)
                rank = _rank(n_chars, doc_id, rid)
                if (own := seen.get(norm)) is None:
                    sha = hashlib.sha256(norm).digest()
                    own = seen[norm] = [len(rows), key_of(norm, sha), sha.hex(), 1, rank]
                    rows.append((rid, doc_id, n_chars, own[1], own[2], norm))
                else:
                    own[3] += 1
                    own[4] = min(own[4], rank)
                    rows.append((rid, doc_id, n_chars, own[1], own[2], None))
                rid += 1
            more = [(None,) * 4] * len(rows)
            for at, _, _, n, (chars, unknown, best_id, best_rid) in seen.values():
                more[at] = (n, -chars, None if unknown else best_id, best_rid)
            columns = [*zip(*rows, strict=True), *zip(*more, strict=True)] if rows else [[] for _ in schema]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def directory(cells: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> list[int]:
    """The bucket of each value of the leading bits, from the number of texts in each of 2**max_depth cells.

    Returns 2**depth bucket numbers. A bucket at ``max_depth`` may stay over its capacity (all its keys then share those
    bits); its owner streams it, so it is right all the same.
    """
    shift = max_depth
    totals = [[0] * (1 << max_depth)]
    for cell, n in cells.items():
        totals[0][cell] = n
    while shift:  # totals[k]: by the leading max_depth - k bits
        last = totals[-1]
        totals.append([last[i] + last[i + 1] for i in range(0, len(last), 2)])
        shift -= 1
    depth, found = 0, [(0, 0)]  # of each place of the directory: (bucket's bits, bucket's own depth)
    todo = [(0, 0)]
    while todo:
        prefix, own = todo.pop()
        if own == max_depth or totals[max_depth - own][prefix] <= capacity:
            continue
        if own == depth:  # the directory doubles
            found = [x for x in found for _ in (0, 1)]
            depth += 1
        for bit in (0, 1):
            child = (prefix * 2 + bit, own + 1)
            span = 1 << (depth - own - 1)
            found[child[0] * span : (child[0] + 1) * span] = [child] * span
            todo.append(child)
    numbers = {x: i for i, x in enumerate(dict.fromkeys(found))}
    return [numbers[x] for x in found]


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's work: entries in key order to one row a text."""
    schema = pa.schema([("key", pa.int64()), ("sha", pa.string()), ("group_size", pa.int64()), ("keep_id", pa.int64()), ("keep_chars", pa.int64()), ("keep_rid", pa.int64())])
    done: list[tuple] = []
    key, chain = None, {}

    def close() -> None:
        for norm, (sha, n, (chars, unknown, best_id, best_rid)) in chain.items():
            done.append((key, sha, n, None if unknown else best_id, -chars, best_rid))
        if len({own[0] for own in chain.values()}) != len(chain):
            raise ValueError(f"two different texts have one SHA-256: {key}")

    for batch in batches:
        for own_key, sha, norm, n, chars, best_id, best_rid in zip(*(batch.column(c).to_pylist() for c in ("key", "sha", "norm", "n", "best_chars", "best_id", "best_rid")), strict=True):
            if own_key != key:
                close()
                key, chain = own_key, {}
            rank = _rank(chars, best_id, best_rid)
            old = chain.get(norm)  # a dict compares the bytes themselves
            chain[norm] = (sha, n, rank) if old is None else (sha, old[1] + n, min(old[2], rank))
        if len(done) >= 10_000:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done = []
    close()
    if done:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)


def exact_dedup(docs: DataFrame, *, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key_of: Callable[[bytes, bytes], int] = sha_key) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are not read), dropped ones too.

    Texts are equal when they are identical without ASCII white space; null counts as empty. The row with the most code
    points stays, then the smallest doc_id, null last; of repeated rows (same id and text) one stays. Empty tables give
    an empty result.

    Returns doc_id, keep_id, group_size, kept, text_sha256, n_chars.
    """
    spark = docs.sparkSession
    entries = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_entries(key_of), _ENTRY), "dedup-entries", compression="zstd")
    texts = entries.filter("norm is not null")
    cell = F.shiftrightunsigned("key", 64 - max_depth)
    counted = {r.cell: r.n for r in texts.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}  # 2**max_depth rows at most
    places = directory(counted, capacity, max_depth)
    depth = len(places).bit_length() - 1
    table = spark.createDataFrame([(i, b) for i, b in enumerate(places)], "place long, bucket long")
    place = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    owned = (
        texts.withColumn("place", place)
        .join(F.broadcast(table), "place")  # 2**max_depth rows at most
        .repartition("bucket")
        .sortWithinPartitions("key")
        .select("key", "sha", "norm", "n", "best_chars", "best_id", "best_rid")
        .mapInArrow(_chains, _GROUP)
    )
    groups = cut(owned, "dedup-groups")
    return entries.select("rid", "doc_id", "n_chars", "key", "sha").join(groups, ["key", "sha"]).select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"), "n_chars", "rid")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one that ``exact_dedup`` keeps; all columns stay, whatever their
    names. A null text is empty and equal to other empty ones, a null id comes last; of repeated rows one stays; an empty table
    stays empty."""
    sha, chars = (_free(docs, c) for c in ("dedup_sha", "dedup_chars"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.withColumn(sha, F.sha2(F.translate(text, SPACES.decode(), "").cast("binary"), 256)).withColumn(chars, F.char_length(text).cast("long"))
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("keep_doc"), F.col("text_sha256").alias("keep_sha"), F.col("n_chars").alias("keep_chars"))
    same = (own[sha] == kept["keep_sha"]) & own["doc_id"].cast("long").eqNullSafe(kept["keep_doc"]) & (own[chars] == kept["keep_chars"])
    return own.join(kept, same, "left_semi").dropDuplicates([sha]).drop(sha, chars)


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
