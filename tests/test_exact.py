"""Exact sums: any digits and exponents, any partitions, against Python's fractions."""

import random
from fractions import Fraction

import pytest

from quillspan.operators import prepare

SPEC = prepare.Spec((prepare.Metric("s", "sum", "v"), prepare.Metric("m", "mean", "v"), prepare.Metric("low", "min", "v"), prepare.Metric("n", "count")), ("g",), "p")


def frame(spark, values):
    return spark.createDataFrame([("2024", g, v) for g, v in values], "p string, g string, v string")


def test_small_and_large_values_add_exactly(spark):
    values = [("a", "1e30"), ("a", "0.1234567"), ("a", "-1E30"), ("b", "1e-300"), ("b", "-1"), ("c", "9" * 40), ("c", "1"), ("d", "-0.000"), ("e", "1e308"), ("e", "1e308"), ("f", "NA"), ("f", "n/a"), ("f", "1e309"), ("f", "1e99999999999")]
    parts = prepare.partials(frame(spark, values), SPEC)
    assert {r.g: (r.text, r.n, r.invalid) for r in parts.select("g", prepare.exact_text("total").alias("text"), "n", "invalid").collect()} == {
        "a": ("0.1234567", 3, 0),
        "b": ("-0." + "9" * 300, 2, 0),
        "c": ("1" + "0" * 40, 2, 0),
        "d": ("0", 1, 0),
        "e": ("2" + "0" * 308, 2, 0),
        "f": ("0", 0, 3),
    }
    got = {(r.g, r.metric_id): r.value for r in prepare.finish(parts, SPEC).collect()}
    assert [got["a", k] for k in ("s", "m", "low", "n")] == [0.1234567, 0.041152233, -1e30, 3.0]
    assert (got["b", "s"], got["c", "m"], got["d", "s"], got["e", "s"], got["f", "s"], got["f", "m"], got["f", "n"]) == (-1.0, 5e39, 0.0, float("inf"), None, None, 4.0)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_sums_equal_fractions_however_they_are_merged(spark, parts):
    rng = random.Random(1)
    values = [(rng.choice("ab"), f"{rng.choice(['', '-', '+'])}{rng.randint(0, 10 ** rng.randint(0, 25))}{rng.choice(['', '.', '.' + str(rng.randint(0, 10 ** 9)), '.000' + str(rng.randint(0, 99))])}{rng.choice(['', f'e{rng.randint(-40, 40)}'])}") for _ in range(600)]
    rows = frame(spark, values).repartition(parts)
    loads = [prepare.partials(rows.filter(f"pmod(hash(v), {parts}) = {k}"), SPEC) for k in range(parts)]
    union = loads[0]
    for load in loads[1:]:
        union = load.unionByName(union)
    merged = prepare.merge_partials(union, ("g",))
    want = {g: sum(Fraction(v) for k, v in values if k == g) for g in "ab"}
    found = {r.g: (Fraction(r.text), r.n) for r in merged.select("g", prepare.exact_text("total").alias("text"), "n").collect()}
    assert found == {g: (want[g], sum(k == g for k, _ in values)) for g in "ab"}
    got = {(r.g, r.metric_id): r.value for r in prepare.finish(merged, SPEC).collect()}
    assert all(got[g, "s"] == float(want[g]) for g in "ab")
