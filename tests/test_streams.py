"""Keyed state of streams: late and restated observations, ids of earlier batches, batches that run again."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspan.streaming import jobs
from quillspan.streaming.state import Deltas

POINT = "series string, t long, value double"


def streamed(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))


def deltas(spark, path, batches, **options):
    stream = streamed(spark, path, batches, POINT).select("series", F.timestamp_seconds("t").alias("at"), "value")
    jobs.stream_observation_delta(stream, str(path / "out"), str(path / "progress"), **options)
    found = spark.read.parquet(str(path / "out"))
    return found, [(r.batch, r.series, int(r.at.timestamp()), r.kind, r.delta, r.restated) for r in found.orderBy("batch", "series", "step").collect()]


def test_late_observations_correct_their_successors(spark, tmp_path):
    batches = [[("a", 100, 5.0), ("a", 300, 9.0)], [("a", 200, 6.0), ("b", 5, 1.0)], [("a", 50, 1.0), ("a", 200, 7.5), (None, 1, 1.0), ("a", None, 1.0)]]
    found, got = deltas(spark, tmp_path, batches, width_seconds=100)
    assert got == [
        (0, "a", 100, "FIRST", None, None), (0, "a", 300, "DELTA", 4.0, None),
        (1, "a", 200, "DELTA", 1.0, None), (1, "a", 300, "CORRECTED", 3.0, None), (1, "b", 5, "FIRST", None, None),
        (2, "a", 50, "FIRST", None, None), (2, "a", 100, "CORRECTED", 4.0, None), (2, "a", 200, "RESTATED", 2.5, 1.5), (2, "a", 300, "CORRECTED", 1.5, None),
    ]
    assert {(r.series, int(r.at.timestamp())): (r.value, r.delta) for r in jobs.final_deltas(found).collect()} == {("a", 50): (1.0, None), ("a", 100): (5.0, 4.0), ("a", 200): (7.5, 2.5), ("a", 300): (9.0, 1.5), ("b", 5): (1.0, None)}


def test_history_is_bounded(spark, tmp_path):
    _, got = deltas(spark, tmp_path, [[("a", 10, 1.0), ("a", 110, 2.0), ("a", 210, 4.0)], [("a", 20, 9.0), ("a", 120, 3.0)]], width_seconds=100, history=2)
    assert [x[2:5] for x in got if x[0] == 1] == [(20, "TOO_LATE", None), (120, "DELTA", 1.0), (210, "CORRECTED", 1.0)]


def test_final_deltas_do_not_depend_on_arrival(spark, tmp_path):
    rng = random.Random(4)
    points = [(s, t, float(rng.randint(0, 99))) for s in "ab" for t in rng.sample(range(5_000), 60)]
    rng.shuffle(points)
    found, _ = deltas(spark, tmp_path, [points[:40], points[40:90], points[90:]], width_seconds=300)
    want = {}
    for s in "ab":
        own = sorted((t, v) for k, t, v in points if k == s)
        want |= {(s, t): (v, v - own[i - 1][1] if i else None) for i, (t, v) in enumerate(own)}
    assert {(r.series, int(r.at.timestamp())): (r.value, r.delta) for r in jobs.final_deltas(found).collect()} == want


def test_a_batch_that_runs_again_gives_the_same_rows(spark, tmp_path, monkeypatch):
    batches = [[("a", 100, 5.0)], [("a", 300, 9.0), ("a", 50, 2.0)], [("a", 200, 1.0)]]
    whole = deltas(spark, tmp_path / "whole", batches)[1]
    run = jobs.run_batches

    def broken(stream, checkpoint, each, **trigger):
        def once(batch, number):
            each(batch, number)
            if number == 1:
                raise RuntimeError("lost after the rows were written, before the batch was marked as done")

        run(stream, checkpoint, once, **trigger)

    monkeypatch.setattr(jobs, "run_batches", broken)
    with pytest.raises(Exception, match="lost after"):
        deltas(spark, tmp_path / "again", batches)
    monkeypatch.setattr(jobs, "run_batches", run)
    assert deltas(spark, tmp_path / "again", [])[1] == whole


def test_ids_of_earlier_batches_are_rejected(spark, tmp_path):
    schema = "n long, id string, bad boolean"
    batches = [[(1, "x", False), (2, "x", False), (3, " ", False), (4, "y", True)], [(5, "x ", False), (6, "y", False), (7, "", False), (8, None, False), (9, "z", True)], [(10, "y", False), (11, "z", False)]]
    stream = streamed(spark, tmp_path, batches, schema)
    jobs.stream_ingest(stream, F.when(F.col("bad"), "bad row"), str(tmp_path / "out"), str(tmp_path / "progress"), id="id", order=["n"], buckets=3)
    read = lambda part: spark.read.parquet(str(tmp_path / "out" / part))
    assert {(r.batch, r.n) for r in read("valid").collect()} == {(0, 1), (0, 3), (1, 6), (1, 7), (1, 8), (2, 11)}
    assert {(r.batch, r.n): r.reason for r in read("rejects").collect()} == {(0, 2): "duplicate id", (0, 4): "bad row", (1, 5): "duplicate id", (1, 9): "bad row", (2, 10): "duplicate id"}
    assert {(r.batch, r["read"], r.skipped) for r in read("receipts").collect()} == {(0, 4, 2), (1, 5, 2), (2, 2, 1)}


def test_a_long_series_is_told_in_frames(tmp_path):
    """A task holds a series' new rows as numbers and gives rows piece by piece: the memory of 400,000 observations, and of as many
    more between them, is bounded."""
    state = {}

    class Kept:
        def __init__(self, name):
            self.name = name

        get = lambda self: state.get(self.name)
        update = lambda self, value: state.update({self.name: value})
        getValue = lambda self, k: state[self.name, k]
        updateValue = lambda self, k, value: state.update({(self.name, k): value})
        removeKey = lambda self, k: state.pop((self.name, k))

    class Handle:
        getValueState = getMapState = lambda self, name, *schema: Kept(name)

    own, n = Deltas(10_000_000, 4_000), 400_000
    own.init(Handle())
    for part in (0, 1):
        frames = (pd.DataFrame({"series": "a", "at": np.arange(i, i + 10_000) * 200 + part, "id": 0, "value": 1.0}) for i in range(0, n, 10_000))
        tracemalloc.start()
        rows = largest = 0
        for frame in own.handleInputRows(("a",), frames, None):
            rows, largest = rows + len(frame), max(largest, len(frame))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == (n if not part else 2 * n - 1) and largest <= 100_000 and peak < 160 * n
    assert own.numbers.get() == (list(range(8)),)
