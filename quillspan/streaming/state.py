"""Keyed state of streaming jobs: what Spark keeps for a key between batches."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Bytes of an id's hash.
DIGEST = 16


class FirstOfId(StatefulProcessor):
    """Passes rows through; a row whose ``_id`` an earlier one had gets the reason ``duplicate id``.

    A key is a bucket of ids; its state is their hashes in one sorted string of bytes.
    """

    def __init__(self, columns: list[str], order: list[str]) -> None:
        self.columns, self.order = columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "ids binary")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        held = self.seen.get()
        blob = bytes(held[0]) if held else b""
        seen = {blob[i : i + DIGEST] for i in range(0, len(blob), DIGEST)}
        before = len(seen)
        for row in sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in self.order)):
            reason = row["reason"]
            if row["_id"] is not None:
                own = hashlib.sha256(row["_id"].encode()).digest()[:DIGEST]
                if own in seen:
                    reason = "duplicate id"
                seen.add(own)
            yield Row(**{c: reason if c == "reason" else row[c] for c in self.columns})
        if len(seen) > before:
            self.seen.update((b"".join(sorted(seen)),))

    def close(self) -> None:
        pass


class Deltas(StatefulProcessor):
    """Compares the observations of a series, a key, with the latest earlier ones, and corrects the next later ones.

    State: the sorted numbers of the buckets that hold observations, and each bucket's times, ids and values in order, as bytes. A
    batch reads the buckets of its rows and their neighbours only, one after the other, and gives rows in frames of at most
    ``2 * FRAME``: in memory are a series' new rows, some 64 bytes each while they are
    sorted, and two buckets.
    """

    def __init__(self, width: int, history: int) -> None:
        self.width, self.history = width, history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getValueState("numbers", "buckets array<long>")
        self.points = handle.getMapState("points", "bucket long", "at binary, id binary, value binary")

    def _open(self, k: int) -> list[np.ndarray]:
        return [np.frombuffer(bytes(own), kind) for own, kind in zip(self.points.getValue((k,)), KINDS, strict=True)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        stored = self.numbers.get()
        order = list(stored[0]) if stored else []
        known, step, last = set(order), 0, None
        parts = list(zip(*[[own[c].to_numpy(kind) for c, kind in zip(("at", "id", "value"), KINDS, strict=True)] for own in rows], strict=True))
        fresh = [np.concatenate(parts.pop(0)) for _ in KINDS]
        place = np.lexsort(fresh[::-1])
        for i, column in enumerate(fresh):
            fresh[i] = column[place]
        del place
        buckets = fresh[0] // self.width
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]).tolist()
        for low, high in zip(starts, [*starts[1:], len(buckets)], strict=True):
            k, own = int(buckets[low]), [column[low:high] for column in fresh]
            place = bisect_left(order, k)
            here = place < len(order) and order[place] == k
            late = not here and place == 0 and len(order) >= self.history
            if late:
                frames = _late(*own)
            else:
                if not here:
                    order.insert(place, k)
                held = self._open(k) if k in known else [np.empty(0, kind) for kind in KINDS]
                if place and (last is None or last[0] != order[place - 1]):
                    last = (order[place - 1], self._open(order[place - 1])[2][-1])
                after = [column[0] for column in self._open(order[place + 1])] if place + 1 < len(order) else None
                merged, new, fresh_at = _merged(held, own)
                frames = _told(merged, new, fresh_at, last[1] if place else None, after)
                final = np.r_[new[1:], True]
                self.points.updateValue((k,), tuple(column[final].tobytes() for column in merged))
                last = (k, merged[2][-1])
                known.add(k)
            for frame in frames:
                yield frame.assign(series=key[0], step=np.arange(step + 1, step + len(frame) + 1))[OUT]
                step += len(frame)
        for k in order[: -self.history]:
            self.points.removeKey((k,))
        if order:
            self.numbers.update((order[-self.history :],))

    def close(self) -> None:
        pass


#: Types of times, ids and values; new rows a frame; columns of a frame.
KINDS, FRAME = (np.dtype("<i8"), np.dtype("<i8"), np.dtype("<f8")), 20_000
OUT = ["series", "at", "id", "value", "kind", "delta", "restated", "step", "compared"]


def _late(at: np.ndarray, name: np.ndarray, value: np.ndarray) -> Iterator[pd.DataFrame]:
    for i in range(0, len(at), FRAME):
        part = slice(i, i + FRAME)
        yield pd.DataFrame({"at": at[part], "id": name[part], "value": value[part], "kind": "TOO_LATE", "delta": np.nan, "restated": np.nan, "compared": False})


def _merged(held: list[np.ndarray], own: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A bucket's held and new observations in order of time and id, held ones first; where another time or id begins, and which
    are new."""
    is_fresh = np.r_[np.zeros(len(held[0]), bool), np.ones(len(own[0]), bool)]
    at, name, value = (np.concatenate(pair) for pair in zip(held, own, strict=True))
    place = np.lexsort((value, is_fresh, name, at))
    at, name, value = at[place], name[place], value[place]
    return [at, name, value], np.r_[True, (at[1:] != at[:-1]) | (name[1:] != name[:-1])], is_fresh[place]


def _told(merged: list[np.ndarray], new: np.ndarray, is_fresh: np.ndarray, before: float | None, after: list | None) -> Iterator[pd.DataFrame]:
    """The rows that tell of a bucket's new observations: each one, then the held one that follows it in the bucket, else
    ``after``, the first one of the next bucket."""
    at, name, value = merged
    n, spots = len(at), np.arange(len(at))
    first = np.maximum.accumulate(np.where(new, spots, 0))
    following = np.minimum.accumulate(np.where(is_fresh, n, spots)[::-1])[::-1]
    exact = lambda a, b: np.array([round(x, 4) for x in (a - b).tolist()])
    places = np.flatnonzero(is_fresh)
    for i in range(0, len(places), FRAME):
        p = places[i : i + FRAME]
        start, nxt = first[p], following[p]
        compared = (start > 0) | (before is not None)
        earlier = np.where(start > 0, value[start - 1], np.nan if before is None else before)
        again = ~new[p]
        kind = np.where(again, "RESTATED", np.where(compared, "DELTA", "FIRST")).astype(object)
        held = nxt < n
        nxt = np.where(held, nxt, 0)
        follow = [np.where(held, column[nxt], 0 if after is None else other) for column, other in zip(merged, after or [0, 0, 0], strict=True)]
        pair = lambda a, b: np.stack([a, b], axis=1).reshape(-1)
        with np.errstate(invalid="ignore"):
            deltas = pair(exact(value[p], earlier), exact(follow[2], value[p]))
            restated = np.where(again, exact(value[p], value[p - 1]), np.nan)
        size = len(p)
        frame = pd.DataFrame({"at": pair(at[p], follow[0]), "id": pair(name[p], follow[1]), "value": pair(value[p], follow[2]), "kind": pair(kind, np.full(size, "CORRECTED", object)), "delta": deltas, "restated": pair(restated, np.full(size, np.nan)), "compared": pair(compared, np.ones(size, bool))})
        yield frame[pair(np.ones(size, bool), held | (after is not None))]
