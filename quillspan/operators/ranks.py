"""Exact ranks and medians of series that no task can hold.

A round summarises the values still in question by a sketch, takes two of its splitters around the rank and counts the rows
below, at, between and above them. The splitters' own rows are settled by the counts, so however many values are equal, a
round leaves about a five-hundredth of the rows between them. What is left is sorted when it is at most ``most`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.shared import written

#: Values that one group may sort, splitters of a round, and tasks that a series is dealt to.
MOST, CELLS, SALTS = 10_000, 1_000, 16


def meet(values: DataFrame, asked: DataFrame, salts: int = SALTS) -> DataFrame:
    """Each row of ``values`` (series, idx, ...) beside every row of ``asked`` (series, ...); a series is dealt to ``salts`` tasks
    by its windows."""
    copies = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return values.withColumn("salt", F.pmod(F.xxhash64("idx"), F.lit(salts)).cast("int")).join(copies, ["series", "salt"]).drop("salt")


def exact_ranks(values: DataFrame, asked: DataFrame, *, most: int = MOST, cells: int = CELLS) -> DataFrame:
    """(series, k, value): the k-th smallest value, from 0, of ``values`` (series, idx, value) for each row of ``asked``
    (series, k, n), n being the series' number of values. Values are not NULL; NaN is the largest. Series without values and
    places outside 0 to n - 1 have no row.
    """
    inside = (F.col("low").isNull() | (F.col("value") > F.col("low"))) & (F.col("high").isNull() | (F.col("value") < F.col("high")))
    none = F.lit(None).cast("double")
    state = asked.filter("k >= 0 and k < n").select("series", "k", F.col("k").alias("rest"), F.col("n").alias("m"), none.alias("low"), none.alias("high"), none.alias("found"))
    while not state.filter((F.col("m") > most) & F.col("found").isNull()).isEmpty():
        busy = (F.col("m") > most) & F.col("found").isNull()
        wide = state.filter(busy)
        shares = [i / cells for i in range(cells + 1)]
        cuts = meet(values, wide.select("series", "k", "low", "high")).filter(inside).groupBy("series", "k").agg(F.percentile_approx("value", shares, 10 * cells).alias("cuts"))
        spot = F.floor(F.col("rest") * cells / F.col("m")).cast("int")
        wide = written(wide.join(cuts, ["series", "k"]).withColumns({"a": F.element_at("cuts", F.greatest(spot, F.lit(1))), "b": F.element_at("cuts", F.least(spot + 3, F.lit(cells + 1)))}).drop("cuts"), "splitters")
        v, a, b = F.col("value"), F.col("a"), F.col("b")
        counts = meet(values, wide.select("series", "k", "low", "high", "a", "b")).filter(inside).groupBy("series", "k").agg(F.count_if(v < a).alias("below"), F.count_if(v <= a).alias("to_a"), F.count_if((v <= a) | (v < b)).alias("to_mid"), F.count_if((v <= a) | (v <= b)).alias("to_b"))
        rows = wide.join(counts, ["series", "k"])
        r = F.col("rest")
        place = F.when(r < F.col("below"), 0).when(r < F.col("to_a"), 1).when(r < F.col("to_mid"), 2).when(r < F.col("to_b"), 3).otherwise(4)
        pick = lambda *by_place: F.element_at(F.array(*by_place), F.col("place") + 1)
        zero = F.lit(0).cast("long")
        rows = rows.withColumn("place", place).select(
            "series",
            "k",
            (r - pick(zero, zero, F.col("to_a"), zero, F.col("to_b"))).alias("rest"),
            pick(F.col("below"), zero, F.col("to_mid") - F.col("to_a"), zero, F.col("m") - F.col("to_b")).alias("m"),
            pick(F.col("low"), a, a, b, b).alias("low"),
            pick(a, a, b, b, F.col("high")).alias("high"),
            pick(none, a, none, b, none).alias("found"),
        )
        state = written(state.filter(~busy).unionByName(rows), "ranks")
    left = meet(values, state.filter("found is null").select("series", "k", "rest", "low", "high")).filter(inside)
    last = left.groupBy("series", "k", "rest").agg(F.array_sort(F.collect_list("value")).alias("all")).select("series", "k", F.element_at("all", (F.col("rest") + 1).cast("int")).alias("value"))
    return last.unionByName(state.filter("found is not null").select("series", "k", F.col("found").alias("value")))


def exact_medians(values: DataFrame, *, most: int = MOST, cells: int = CELLS) -> DataFrame:
    """(series, middle, n) of ``values`` (series, idx, value), the mean of the two middle values for an even number; a written
    table. Rows with a NULL series, index or value take no part."""
    known = values.dropna(subset=["series", "idx", "value"])
    sizes = written(known.groupBy("series").agg(F.count("*").alias("n")), "sizes")
    asked = sizes.select("series", "n", F.explode(F.array_distinct(F.expr("array((n - 1) div 2, n div 2)"))).alias("k"))
    ranks = exact_ranks(known, asked, most=most, cells=cells)
    return written(ranks.groupBy("series").agg((0.5 * F.min("value") + 0.5 * F.max("value")).alias("middle")).join(sizes, "series"), "medians")
