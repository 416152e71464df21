"""Exact medians by refined splitters, and packs of long documents, against plain walks."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillspan.operators import ranks, temporal, text

SHAPES = {
    "spread": lambda r: [r.uniform(-1, 1) for _ in range(3000)],
    "wide": lambda r: [r.choice([-1, 1]) * 10.0 ** r.randint(-300, 300) for _ in range(3001)],
    "ties": lambda r: [5.0] * 1500 + [r.uniform(5, 6) for _ in range(400)] + [6.0] * 1500,
    "two": lambda r: [1.0] * 1000 + [2.0] * 1000,
    "one": lambda r: [7.0] * 2001,
    "short": lambda r: [3.0, 1.0],
    "single": lambda r: [4.0],
    "outlier": lambda r: [float(i % 11) for i in range(2500)] + [1e300, -1e300],
}


def long(spark, shapes):
    rows = [(name, i, v) for name, values in shapes.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows + [("spread", 10**6, None), (None, 1, 1.0), ("lost", None, 1.0)], "series string, idx int, value double")


def test_medians_are_exact_when_rows_must_be_narrowed(spark):
    shapes = {name: make(random.Random(3)) for name, make in SHAPES.items()}
    for most, cells in ((50, 20), (10_000, 1_000)):
        got = {r.series: (r.middle, r.n) for r in ranks.exact_medians(long(spark, shapes), most=most, cells=cells).collect()}
        assert got == {name: (float(np.median(values)), len(values)) for name, values in shapes.items()}


def test_every_rank_of_a_series(spark):
    values = SHAPES["ties"](random.Random(5))
    n = len(values)
    asked = [0, 1, 1499, 1500, 1650, 1899, 1900, n - 1]
    rows = spark.createDataFrame([("a", k, n) for k in asked + [-1, n]] + [("b", 0, 5)], "series string, k long, n long")
    got = ranks.exact_ranks(long(spark, {"a": values}), rows, most=40, cells=25).collect()
    assert {r.k: r.value for r in got} == {k: sorted(values)[k] for k in asked}


def test_candidates_do_not_depend_on_what_a_task_may_sort(spark):
    points = long(spark, {name: make(random.Random(7)) for name, make in SHAPES.items()})
    few, many = (sorted(map(tuple, temporal.anomaly_candidate(points.filter("idx < 5000 or idx is null"), most=most).collect()), key=str) for most in (300, 10_000))
    assert few == many and any(r[3] for r in few)


def test_packs_of_a_long_document_equal_a_walk(spark):
    sizes = [random.Random(1).choice([1, 5, 30, 99, 100, 101, 250]) for _ in range(30_000)]
    docs = {1: sizes, 2: [100], 3: [40, 58, 1], 4: [0, 0]}
    rows = spark.createDataFrame([(d, i, n) for d, own in docs.items() for i, n in enumerate(own)] + [(None, 0, 3)], "doc_id long, pos int, n int").withColumn("passage", F.repeat(F.lit("x"), F.col("n"))).repartition(5)
    want = []
    for d, own in docs.items():
        packs = []
        for i, n in enumerate(own):
            if packs and packs[-1][2] + 2 + n <= 100:
                packs[-1][1:] = [i, packs[-1][2] + 2 + n]
            else:
                packs.append([i, i, n])
        want += [(d, k, *p) for k, p in enumerate(packs)]
    assert sorted(map(tuple, text.pack_passages(rows, 100).collect())) == want
    assert text.pack_passages(rows.limit(0), 100).collect() == []
