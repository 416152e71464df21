"""Byte-level BPE encoding and decoding in numpy.

Texts are cut into matches of the tokenizer's pattern by array operations on code points; each different match is encoded
once. Matches of about one length form a padded matrix of token ids: every round, each row merges its leftmost pair of
minimum rank, found in a hash table of pairs, and rows are compacted. Matches over ``LONG`` bytes, where a round a merge
would be quadratic, merge by the same rule with a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 256
#: Characters that are cut at once, and different matches that a worker remembers.
CHUNK, REMEMBERED = 250_000, 100_000
NONE = np.int32(2**31 - 1)
OTHER, LETTER, NUMBER, SPACE = range(4)


#: Where version 16 of Unicode, which the tokenizer knows, has added letters and numbers to version 15.1.
ADDED = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105FF), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4), (0x11380, 0x113FF), (0x116D0, 0x116FF), (0x11BC0, 0x11BFF), (0x13460, 0x143FF), (0x16100, 0x1613F), (0x16D40, 0x16D7F), (0x1CC00, 0x1CEBF), (0x1E5D0, 0x1E5FF))


@cache
def classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other, by their Unicode properties."""
    found = np.zeros(0x110000, np.uint8)
    known = np.array([unicodedata.category(chr(c)) != "Cn" for c in range(0x110000)])
    for low, high in ADDED:
        known[low : high + 1] = True
    points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
    every = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            own = points[m.start() : m.end()]
            found[own[known[own]]] = kind
    return found


def match_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where the matches of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` start.

    ``points``: the code points of texts one after the other; ``doc_starts``: where non-empty texts start, ascending.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[doc_starts] = True
    doc = np.zeros(n + 1, bool)
    doc[doc_starts] = doc[n] = True
    at = np.flatnonzero(new)
    end = np.r_[at[1:], n]
    what = kind[at]
    starts = new.copy()
    # The last white space before other text is a match of its own, or a blank that leads the next match.
    led = (what == SPACE) & ~doc[end]
    last = end[led] - 1
    starts[last] = True
    blank = last[points[last] == 32]
    starts[blank + 1] = False
    # Contractions: an apostrophe that starts a match, alone in its run, before letters.
    alone = at[(what == OTHER) & (end - at == 1) & ~doc[end] & starts[at]]
    alone = alone[(points[alone] == 39)]
    alone = alone[kind[alone + 1] == LETTER]
    a = points[alone + 1]
    b = np.where(alone + 2 < n, points[np.minimum(alone + 2, n - 1)], 0)
    b = np.where((alone + 2 < n) & ~doc[np.minimum(alone + 2, n)], b, 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
    for which, size in ((one, 2), (two & ~one, 3)):
        cut = alone[which]
        starts[cut + 1] = False
        rest = cut + size
        starts[rest[rest < n]] = True
    return np.flatnonzero(starts)


class BytePairs:
    """A vocabulary of byte strings with ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self._hash(np.array(keys, np.uint64), np.array(values, np.int32))
        lengths = np.array([len(t) for t in self.tokens])
        self.length, self.offset, self.flat = lengths, np.r_[0, np.cumsum(lengths)[:-1]], np.frombuffer(b"".join(self.tokens), np.uint8)

    @classmethod
    def read(cls, content: bytes) -> BytePairs:
        """From a file of lines of a base64 token and its rank."""
        return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in content.splitlines() if line)})

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table: a pair lies at its hash's place or at one of the next ``self.probes - 1``."""
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, NONE, np.int32)
        place, self.probes, left = self._place(keys), 0, np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = left[self.values[place[left]] == NONE]
            _, first = np.unique(place[free], return_index=True)
            won = free[first]
            self.keys[place[won]], self.values[place[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            place[left] = (place[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merger, or NONE; negative ids are padding and never merge."""
        keys = left.astype(np.uint32).astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)
        place = self._place(keys)
        found = np.where(self.keys[place] == keys, self.values[place], NONE)
        open_ = np.flatnonzero((found == NONE) & (self.values[place] != NONE))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & self.mask
            hit = self.keys[place[open_]] == keys[open_]
            found[open_[hit]] = self.values[place[open_[hit]]]
            open_ = open_[~hit & (self.values[place[open_]] != NONE)]
        return found

    def encode_matches(self, matches: list[bytes]) -> list[bytes]:
        """The ids of each match as little-endian 32-bit numbers."""
        found: list[bytes] = [b""] * len(matches)
        whole = self.ranks.get
        left = []
        for i, m in enumerate(matches):
            rank = whole(m)
            if rank is not None:
                found[i] = rank.to_bytes(4, "little")
            elif len(m) > LONG:
                found[i] = self._by_heap(m)
            else:
                left.append(i)
        left.sort(key=lambda i: len(matches[i]))
        at = 0
        while at < len(left):
            width, end = len(matches[left[at]]), at
            most = max(width + 1, width * 5 // 4)
            while end < len(left) and len(matches[left[end]]) <= most and end - at < 65_536:
                end += 1
            part = left[at:end]
            for i, ids in zip(part, self._by_matrix([matches[i] for i in part]), strict=True):
                found[i] = ids
            at = end
        return found

    def _by_matrix(self, matches: list[bytes]) -> list[bytes]:
        lengths = np.array([len(m) for m in matches])
        n, width = len(matches), int(lengths.max())
        real = np.arange(width) < lengths[:, None]
        ids = np.full((n, width), -1, np.int32)
        ids[real] = self.of_byte[np.frombuffer(b"".join(matches), np.uint8)]
        ranks = np.full((n, width), NONE, np.int32)
        inner = real[:, 1:]
        ranks[:, :-1][inner] = self.pair_ranks(ids[:, :-1][inner], ids[:, 1:][inner])
        rows, done = np.arange(n), np.full((n, width), -1, np.int32)
        while len(rows):
            low = ranks.argmin(1)
            every = np.arange(len(rows))
            best = ranks[every, low]
            if (stop := best == NONE).any():
                done[rows[stop], : ids.shape[1]] = ids[stop]
                go = ~stop
                rows, ids, ranks, low, best = rows[go], ids[go], ranks[go], low[go], best[go]
                if not len(rows):
                    break
                every = np.arange(len(rows))
            width = ids.shape[1]
            ids[every, low] = best
            keep = np.ones(ids.shape, bool)
            keep[every, low + 1] = False
            ids, ranks = ids[keep].reshape(-1, width - 1), ranks[keep].reshape(-1, width - 1)
            after = low + 1 < width - 1
            ranks[every, low] = NONE
            r, c = every[after], low[after]
            ranks[r, c] = self.pair_ranks(ids[r, c], ids[r, c + 1])
            before = low > 0
            r, c = every[before], low[before]
            ranks[r, c - 1] = self.pair_ranks(ids[r, c - 1], ids[r, c])
        sizes = (done >= 0).sum(1)
        flat = done[np.arange(done.shape[1]) < sizes[:, None]].astype("<u4").tobytes()
        ends = np.r_[0, np.cumsum(sizes)] * 4
        return [flat[a:b] for a, b in pairwise(ends.tolist())]

    def _by_heap(self, match: bytes) -> bytes:
        ids = self.of_byte[np.frombuffer(match, np.uint8)].tolist()
        n, tokens, rank_of = len(ids), self.tokens, self.ranks.get
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(tokens[ids[i]] + tokens[ids[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = nxt[i] if ids[i] >= 0 else n
            if j >= n or rank_of(tokens[ids[i]] + tokens[ids[j]]) != rank:
                continue
            ids[i], ids[j], nxt[i] = rank, -1, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for left in (prv[i], i):
                if left >= 0 and nxt[left] < n and (r := rank_of(tokens[ids[left]] + tokens[ids[nxt[left]]])) is not None:
                    heapq.heappush(heap, (r, left))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids one after the other."""
        sizes = self.length[ids]
        shift = self.offset[ids] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(sizes.sum())]


class Encoder:
    """Encodes texts, remembering the matches that it has seen."""

    def __init__(self, pairs: BytePairs) -> None:
        self.pairs = pairs
        self.seen: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        starts = match_starts(points, (ends - sizes)[sizes > 0])
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        place = np.r_[0, np.cumsum(width, dtype=np.int64)]
        raw = joined.encode()
        cuts = place[np.r_[starts, len(points)]].tolist()
        matches = [raw[a:b] for a, b in pairwise(cuts)]
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        seen = self.seen
        fresh = [m for m in dict.fromkeys(matches) if m not in seen]
        seen.update(zip(fresh, self.pairs.encode_matches(fresh), strict=True))
        found = list(map(seen.__getitem__, matches))
        first = np.searchsorted(starts, np.r_[0, ends]).tolist()
        return [b"".join(found[a:b]) for a, b in pairwise(first)]


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= CHUNK:
            yield part
            part, n = [], 0
    if part:
        yield part


def _digests(content: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(BytePairs.read(content))
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for texts in _parts([t or "" for t in batch.column("text").to_pylist()]):
                ids = encoder.encode(texts)
                every = np.frombuffer(b"".join(ids), "<u4")
                decoded = encoder.pairs.decode(every).tobytes()
                ends = np.r_[0, np.cumsum(encoder.pairs.length[every])]
                at = 0
                for own in ids:
                    end = at + len(own) // 4
                    n.append(end - at)
                    ids_sha.append(hashlib.sha256(own).hexdigest())
                    decoded_sha.append(hashlib.sha256(decoded[ends[at] : ends[end]]).hexdigest())
                    at = end
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(content: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(BytePairs.read(content))
        for batch in batches:
            ids = [own for texts in _parts([t or "" for t in batch.column("text").to_pylist()]) for own in encoder.encode(texts)]
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            ends = pa.array(np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32))
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "ids"])

    return run


def _decoded(content: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = BytePairs.read(content)
        for batch in batches:
            rows = batch.column("ids").to_pylist()
            found = [None if r is None else pairs.decode(np.array(r, np.int64)).tobytes() for r in rows]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "raw"])

    return run


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, ids) for each row of ``docs`` (doc_id, text); null and empty texts have no ids; repeated rows stay.

    ``ranks``: the content of a file of lines of a base64 token and its rank.
    """
    return _plain(docs).mapInArrow(_encoded(ranks), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, raw): the bytes that the ids stand for; null ids give null."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(_decoded(ranks), "doc_id long, raw binary")


def digests(docs: DataFrame, ranks: bytes) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    numbers) and decoded_sha256 (of the bytes that the ids decode to). Null texts count as empty and have no ids; null ids,
    repeated rows and texts of any length stay as they are; other columns are not read; an empty table gives an empty result."""
    return _plain(docs).mapInArrow(_digests(ranks), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
