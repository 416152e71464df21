"""Edge cases of the time-series operators: missing is never zero, gaps, zero baselines, short series, planted effects."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import temporal as t


def points(spark, values, series="a", start=0):
    return spark.createDataFrame([(series, start + i, None if v is None else float(v)) for i, v in enumerate(values) if v != "gap"], "series string, idx int, value double")


def by_idx(df, *columns):
    return {r.idx: tuple(r[c] for c in columns) for r in df.collect()}


def test_labels_round_trip_and_bad_ones_are_null(spark):
    rows = spark.createDataFrame([("2024-02",), ("2024-13",), ("2024-1",), ("x",), (None,)], "l string")
    got = rows.select("l", t.calendar_index(F.col("l"), "calendar-month").alias("i")).withColumn("back", t.calendar_label(F.col("i"), "calendar-month")).collect()
    assert [(r.i, r.back) for r in got] == [(2024 * 12 + 1, "2024-02")] + [(None, None)] * 4
    day = spark.createDataFrame([("2024-02-29",), ("2023-02-29",)], "l string").select(t.calendar_index(F.col("l"), "calendar-day").alias("i")).collect()
    assert [r.i for r in day] == [19782, None]


def test_growth_keeps_reasons(spark):
    got = by_idx(t.period_over_period(points(spark, [0, 5, None, "gap", 10, -10, 5]), 1), "value", "flag")
    assert got == {1: (None, "ZERO_BASELINE"), 2: (None, "MISSING_OR_GAP"), 3: (None, "MISSING_OR_GAP"), 4: (None, "MISSING_OR_GAP"), 5: (-2.0, None), 6: (1.5, None)}
    with pytest.raises(ValueError, match="undefined"):
        t.yoy(points(spark, [1]), "calendar-day")


def test_windows_that_are_not_whole(spark):
    assert by_idx(t.rolling_mean(points(spark, [1, 2, "gap", 4, 5, 6]), 2), "value", "flag") == {1: (1.5, None), 2: (None, "INCOMPLETE_WINDOW"), 3: (None, "INCOMPLETE_WINDOW"), 4: (4.5, None), 5: (5.5, None)}
    assert by_idx(t.rolling_delta(points(spark, [1, 2, "gap", 4]), 1), "value", "flag") == {1: (1.0, None), 2: (None, "INCOMPLETE_WINDOW"), 3: (None, "INCOMPLETE_WINDOW")}


def test_cagr_flags(spark):
    both = points(spark, [100, "gap", 121], "a").unionByName(points(spark, [0, 5], "b")).unionByName(points(spark, [3], "c"))
    got = {r.series: (r.value, r.flag) for r in t.cagr(both, "calendar-year").collect()}
    assert got == {"a": (0.1, "INTERIOR_GAPS"), "b": (None, "NON_POSITIVE_ENDPOINT"), "c": (None, "INSUFFICIENT_POINTS")}


def test_a_planted_spike_is_the_only_candidate(spark):
    values = [100, 101, 99, 100, 102, 98, 180, 100, 101, 99, 100, 101]
    rows = t.anomaly_candidate(points(spark, values)).collect()
    assert [r.idx for r in rows if r.candidate] == [6]
    flat = t.anomaly_candidate(points(spark, [5] * 6)).collect()
    assert {r.flag for r in flat} == {"ZERO_DISPERSION"} and not any(r.candidate for r in flat)
    assert {r.flag for r in t.anomaly_candidate(points(spark, [1, 2, 9])).collect()} == {"INSUFFICIENT_POINTS"}


def test_a_level_shift_is_found_whatever_the_partitions(spark):
    values = [10, 11, 10, 9, 10, 20, 21, 19, 20, 20]
    for n in (1, 3, 7):
        r = t.change_point_candidate(points(spark, values).repartition(n)).first()
        assert r.idx == 5 and r.score > 0.98 and (r.before, r.after) == (10.0, 20.0)
    assert t.change_point_candidate(points(spark, [1, 2, 3])).first().flag == "INSUFFICIENT_POINTS"
    assert t.change_point_candidate(points(spark, [4] * 8)).first().flag == "ZERO_DISPERSION"


def test_lags_of_a_shifted_series(spark):
    x = [1, 3, 2, 5, 4, 6, 9, 7]
    got = {r.lag: r for r in t.lagged_comparison(points(spark, ["gap", *x][1:], start=1), points(spark, x), 2).collect()}
    assert got[1].value == 1.0 and got[1].pairs == 8
    flat = t.lagged_comparison(points(spark, [1] * 5), points(spark, x), 1).collect()
    assert {r.flag for r in flat} == {"ZERO_VARIANCE"}
    assert {r.flag for r in t.lagged_comparison(points(spark, [1, 2]), points(spark, x), 0).collect()} == {"INSUFFICIENT_PAIRS"}


def test_shares_cohorts_baselines_and_breaks(spark):
    got = by_idx(t.share(points(spark, [1, 2, None, 4]), points(spark, [2, 0, 5, "gap"])), "value", "flag")
    assert got == {0: (0.5, None), 1: (None, "ZERO_DENOMINATOR"), 2: (None, "MISSING_OR_GAP"), 3: (None, "MISSING_OR_GAP")}
    assert by_idx(t.cohort_comparison(points(spark, [0, 4, 6])), "value") == {0: (0.0,), 1: (100.0,), 2: (150.0,)}
    assert [r.flag for r in t.indexed_baseline(points(spark, [0, 4]), 0).collect()] == ["ZERO_BASELINE"]
    assert [r.flag for r in t.indexed_baseline(points(spark, [1, 4]), 9).collect()] == ["MISSING_BASELINE"]
    r = t.before_after(points(spark, [1, 3, "gap", 10]), 2).first()
    assert (r.before, r.after, r.difference, r.flag) == (2.0, 10.0, 8.0, "EXCLUDED_MISSING")
    assert t.before_after(points(spark, [1, 3]), 0).first().flag == "EMPTY_SIDE"


def test_errors_of_series(spark):
    rows = [("m", {"r": "x"}, "2024-01", "calendar-month", 1.0), ("m", {"r": "x"}, "2024-01", "calendar-month", 2.0), ("m", {"r": "y"}, "2024", "calendar-year", 1.0), ("m", {"r": "y"}, "2024-02", "calendar-month", 1.0), ("m", {"r": "z"}, "bad", "calendar-month", 1.0), ("m", {"q": "z"}, "2024-03", "calendar-month", None)]
    df = spark.createDataFrame(rows, "metric_id string, dims map<string,string>, period string, basis string, value double")
    good, errors = t.extract_series(df, "m")
    assert {r.series: r.error for r in errors.collect()} == {"r=x": "DUPLICATE_WINDOW", "r=y": "MIXED_BASIS", "r=z": "BAD_LABEL"}
    assert [(r.series, r.value) for r in good.collect()] == [("q=z", None)]


def test_empty_tables(spark):
    none = points(spark, [1]).limit(0)
    for df in (t.gap_fill(none), t.mom(none, "calendar-month"), t.rolling_mean(none, 2), t.cagr(none, "calendar-year"), t.anomaly_candidate(none), t.change_point_candidate(none), t.cohort_comparison(none)):
        assert df.count() == 0
    assert not math.isnan(t.lagged_comparison(none, none, 1).count())


#: Published cases of temporal operators and their results.
SPIKE = [100, 103, 98, 101, 99, 102, 180, 100, 97, 101, 103, 99]
SHIFT = [50, 52, 49, 51, 50, 48, 51, 50, 49, 52, 50, 51, 70, 69, 71, 72, 70, 68, 71, 70, 69, 71, 72, 70]
TREATED, REFERENCE = [100, 101, 99, 100, 120, 121, 119, 122], [90, 91, 89, 90, 91, 90, 92, 91]
STATIONS, SHOPS = [10, 14, 19, 25, 30, 37, 41, 48, 55, 60], [200, 206, 211, 219, 224, 230, 237, 241, 249, 255]


def test_published_cases(spark):
    spike = by_idx(t.anomaly_candidate(points(spark, SPIKE)), "z", "candidate")
    assert [(i, z) for i, (z, candidate) in spike.items() if candidate] == [(6, 35.7485)]
    shift = t.change_point_candidate(points(spark, SHIFT)).first()
    assert shift.idx == 12 and round(shift.score, 6) == 0.986639
    both = points(spark, TREATED, "a").unionByName(points(spark, REFERENCE, "b"))
    assert t.control_comparison(both, "a", "b", 4).first().difference == 19.5
    lags = {r.lag: r.value for r in t.lagged_comparison(points(spark, SHOPS), points(spark, STATIONS), 1).collect()}
    assert round(lags[0], 6) == 0.997912


def test_windows_without_a_value_stay(spark):
    got = by_idx(t.cohort_comparison(points(spark, [0, 5, "gap", 10])), "value", "flag")
    assert got == {0: (0.0, None), 1: (100.0, None), 2: (None, "MISSING_OR_GAP"), 3: (200.0, None)}
    assert by_idx(t.cohort_comparison(points(spark, [0, None])), "value", "flag") == {0: (None, "MISSING_OR_GAP"), 1: (None, "MISSING_OR_GAP")}
    flags = by_idx(t.anomaly_candidate(points(spark, [1, 2, "gap", 4, 9, 7])), "candidate", "flag")
    assert len(flags) == 6 and flags[2] == (False, "MISSING_OR_GAP") and flags[0][1] is None


def test_thousands_of_pairs_equal_calls_of_each(spark, monkeypatch):
    monkeypatch.setattr(t, "STRETCH", 16)
    rng = random.Random(2)
    series = {f"s{k}": {i: (None if rng.random() < 0.1 else rng.gauss(0, 1)) for i in range(rng.randint(-40, 0), rng.randint(1, 60)) if rng.random() < 0.8} for k in range(60)}
    series["flat"] = {i: 1.0 for i in range(30)}
    rows = [(k, i, v) for k, own in series.items() for i, v in own.items()]
    names = [(a, b) for a in series for b in series if a != b] + [("s0", "nobody"), ("s1", "s2")]
    found = t.lagged_pairs(spark.createDataFrame(rows, "series string, idx int, value double"), spark.createDataFrame(names, "series string, reference string"), 4).collect()
    assert len(found) == (61 * 60 + 1) * 9
    for r in rng.sample(found, 600) + [r for r in found if r.reference == "nobody" or "flat" in (r.series, r.reference)][:200]:
        own, other = series[r.series], series.get(r.reference, {})
        both = [(v, other[i - r.lag]) for i, v in own.items() if v is not None and other.get(i - r.lag) is not None]
        assert r.pairs == len(both)
        x, y = np.array(both).reshape(-1, 2).T
        if len(both) < 3:
            assert (r.value, r.flag) == (None, "INSUFFICIENT_PAIRS")
        elif x.std() == 0 or y.std() == 0:
            assert (r.value, r.flag) == (None, "ZERO_VARIANCE")
        else:
            assert abs(r.value - np.corrcoef(x, y)[0, 1]) < 1e-9 and r.flag is None


def test_cohorts_need_two_series_and_their_dimension(spark):
    two = points(spark, [2, 4], "age=1,area=x").unionByName(points(spark, [5, None], "age=2,area=x"))
    got = {(r.series[4], r.idx): (r.value, r.flag) for r in t.cohort_comparison(two, "age").collect()}
    assert got == {("1", 0): (100.0, None), ("1", 1): (200.0, None), ("2", 0): (100.0, None), ("2", 1): (None, "MISSING_OR_GAP")}
    assert {(r.value, r.flag) for r in t.cohort_comparison(two, "ag").collect()} == {(None, "NO_COHORT_DIMENSION")}
    assert {(r.value, r.flag) for r in t.cohort_comparison(two.filter("series like '%=1,%'"), "age").collect()} == {(None, "TOO_FEW_SERIES")}


def test_a_derived_artifact_is_named_by_its_whole_declaration(spark):
    rows = points(spark, [1, 2, 3])
    make = lambda spec: t.derived_artifact(rows, "a", "h", spec).first()
    one = make({"operation": "rolling_mean", "width": 2})
    assert one == make({"width": 2, "operation": "rolling_mean"}) and one.artifact_id != make({"operation": "rolling_mean", "width": 3}).artifact_id
    assert one.artifact_id.startswith("derived:") and (one.results, one.first_idx, one.last_idx) == (3, 0, 2)
    assert t.derived_artifact(rows.limit(0), "a", "h", {"operation": "yoy"}).collect() == []
    sources = spark.createDataFrame([("d", ["old"]), ("e", None)], "dataset_id string, refs array<string>")
    assert [r.refs for r in t.derived_provenance(sources, "a", {"operation": "rolling_mean", "width": 2}).orderBy("dataset_id").collect()] == [["old", *one.refs], one.refs]
