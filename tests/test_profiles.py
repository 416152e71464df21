"""Profiles: trimmed cells, shortest decimals, and distinct values that are exact up to the cap and bounded beyond."""

import pytest

from quillspan.operators import profile


def test_cells_are_trimmed_and_numbers_as_they_are(spark):
    rows = spark.createDataFrame([(" a", "0.00001", "1", "1e300"), ("a\t", " 5 ", "99999999999999999999", "-2.50"), ("NA ", "", "2", "n/a")], "s string, x string, i string, e string")
    got = {r.name: r for r in profile.profile_table(rows).collect()}
    assert (got["s"].distinct_values, got["s"].non_null, got["s"].nulls, got["s"].samples) == (1, 2, 1, "a")
    assert (got["x"].low, got["x"].high, got["x"].type) == ("0.00001", "5", "NUMBER")
    assert (got["i"].type, got["i"].low, got["i"].high) == ("NUMBER", "1", "1" + "0" * 20)
    assert (got["e"].low, got["e"].high) == ("-2.5", "1" + "0" * 300)


@pytest.mark.parametrize("n, want", [(0, (0, False)), (9_999, (9_999, False)), (10_000, (10_000, False)), (10_001, (10_000, True)), (60_000, (10_000, True))])
def test_distinct_values_are_exact_up_to_the_cap(spark, n, want):
    rows = spark.range(2 * n).selectExpr(f"concat('id-', cast(id % {max(n, 1)} as string)) as v").repartition(7)
    r = profile.profile_table(rows).first() if n else profile.profile_table(rows.unionByName(spark.sql("select '' as v"))).first()
    assert (r.distinct_values, r.capped) == want
    assert r.samples == ("|".join(sorted(f"id-{k}" for k in range(n))[:5]) if n else "")


def test_shuffles_hold_no_distinct_values(spark):
    rows = spark.range(20_000).selectExpr("cast(id as string) as v").repartition(4)
    plan = profile.profile_table(rows)._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("Aggregate [")[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert all("cell" not in k for k in keys) and keys
