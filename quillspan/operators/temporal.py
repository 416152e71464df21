"""Time-series operators over calendar windows: growth, rolling, shares, cohorts, breaks, lags, anomalies, change points.

All take long tables of points, ``series`` STRING, ``idx`` INT (a window's calendar index) and ``value`` DOUBLE, and run for
every series at once. Unknown is never zero: a missing, gapped or zero-based input gives a NULL value and a reason in ``flag``.
Rows with a NULL series or index take no part; repeated windows of a series are an error row of ``extract_series``.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.ranks import MOST, exact_medians, meet

OPERATION_VERSION = "1"
MISSING, ZERO_BASELINE, ZERO_DENOMINATOR = "MISSING_OR_GAP", "ZERO_BASELINE", "ZERO_DENOMINATOR"
#: Windows in a year by calendar basis; days have no fixed number.
YEAR_LAG = {"calendar-year": 1, "calendar-month": 12}
FORMATS = {"calendar-year": "yyyy", "calendar-month": "yyyy-MM", "calendar-day": "yyyy-MM-dd"}


def calendar_index(label: Column, basis: str) -> Column:
    """A window's label to its index: the year, year * 12 + month - 1, or days since 1970-01-01; NULL for other labels."""
    shape = {"calendar-year": r"^\d{4}$", "calendar-month": r"^\d{4}-\d{2}$", "calendar-day": r"^\d{4}-\d{2}-\d{2}$"}[basis]
    day = F.when(label.rlike(shape), F.to_date(F.try_to_timestamp(label, F.lit(FORMATS[basis]))))
    if basis == "calendar-year":
        return F.year(day)
    if basis == "calendar-month":
        return F.year(day) * 12 + F.month(day) - 1
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def calendar_label(idx: Column, basis: str) -> Column:
    """The inverse of ``calendar_index``."""
    if basis == "calendar-year":
        return F.lpad(idx.cast("string"), 4, "0")
    if basis == "calendar-month":
        return F.concat(F.lpad(F.floor(idx / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((idx % 12 + 1).cast("string"), 2, "0"))
    return F.date_add(F.lit("1970-01-01").cast("date"), idx.cast("int")).cast("string")


def series_key(dims: Column) -> Column:
    """A map of dimensions as one text, its keys in order; maps themselves cannot be compared."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(dims)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def extract_series(results: DataFrame, metric: str, where: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, errors) of one metric's results (metric_id, dims MAP, period, basis, value) with the given dimensions.

    A dimension that a result lacks never matches. Errors, one row a series: MIXED_BASIS, DUPLICATE_WINDOW, BAD_LABEL; such
    series have no points.
    """
    own = results.filter(F.col("metric_id") == metric)
    for k, v in (where or {}).items():
        own = own.filter(F.element_at("dims", F.lit(k)) == v)
    idx = F.coalesce(*[F.when(F.col("basis") == b, calendar_index(F.col("period"), b)) for b in FORMATS])
    own = own.select(series_key(F.col("dims")).alias("series"), "basis", idx.alias("idx"), F.col("value").cast("double").alias("value"))
    facts = own.groupBy("series").agg(F.count_distinct("basis").alias("bases"), (F.count("idx") - F.count_distinct("idx")).alias("repeats"), F.count_if(F.col("idx").isNull()).alias("bad"))
    judged = facts.select("series", F.when(F.col("bad") > 0, "BAD_LABEL").when(F.col("bases") > 1, "MIXED_BASIS").when(F.col("repeats") > 0, "DUPLICATE_WINDOW").alias("error"))
    errors = judged.filter("error is not null")
    points = own.join(errors, "series", "left_anti").select("series", "idx", "value")
    return points, errors


def gap_fill(points: DataFrame) -> DataFrame:
    """Points with a NULL row for each window missing between a series' first and last: series, idx, value, is_gap."""
    spans = points.groupBy("series").agg(F.min("idx").alias("low"), F.max("idx").alias("high"))
    every = spans.select("series", F.explode(F.sequence("low", "high")).alias("idx"))
    marked = points.select("series", "idx", "value", F.lit(False).alias("is_gap"))
    return every.join(marked, ["series", "idx"], "left").select("series", "idx", "value", F.coalesce("is_gap", F.lit(True)).alias("is_gap"))


def _order() -> Window:
    return Window.partitionBy("series").orderBy("idx")


def period_over_period(points: DataFrame, lag: int, places: int = 9) -> DataFrame:
    """(v - v[-lag]) / abs(v[-lag]) for each window that has an earlier one, gaps too: series, idx, value, flag."""
    w = _order()
    rows = gap_fill(points).withColumn("before", F.lag("value", lag).over(w)).withColumn("n", F.row_number().over(w)).filter(F.col("n") > lag)
    value = F.round(F.try_divide(F.col("value") - F.col("before"), F.abs("before")), places)
    flag = F.when(F.col("value").isNull() | F.col("before").isNull(), MISSING).when(F.col("before") == 0, ZERO_BASELINE)
    return rows.select("series", "idx", value.alias("value"), flag.alias("flag"))


def yoy(points: DataFrame, basis: str) -> DataFrame:
    """Change over a year; undefined for days."""
    if basis not in YEAR_LAG:
        raise ValueError(f"change over a year is undefined for {basis}")
    return period_over_period(points, YEAR_LAG[basis])


def _monthly(name: str, basis: str) -> None:
    if basis != "calendar-month":
        raise ValueError(f"{name} is undefined for {basis}; period_over_period takes any lag")


def mom(points: DataFrame, basis: str) -> DataFrame:
    """Change over a month; undefined for years and days."""
    _monthly("mom", basis)
    return period_over_period(points, 1)


def qoq(points: DataFrame, basis: str) -> DataFrame:
    """Change over three months; undefined for years and days."""
    _monthly("qoq", basis)
    return period_over_period(points, 3)


def cagr(points: DataFrame, basis: str) -> DataFrame:
    """Compound yearly growth between a series' first and last recorded value: series, value, flag; undefined for days. Flags
    are joined by commas, INTERIOR_GAPS first."""
    if basis not in YEAR_LAG:
        raise ValueError(f"growth a year is undefined for {basis}")
    known = F.col("value").isNotNull()
    idx = F.when(known, F.col("idx"))
    ends = gap_fill(points).groupBy("series").agg(F.min_by("value", idx).alias("first"), F.max_by("value", idx).alias("last"), F.min(idx).alias("a"), F.max(idx).alias("b"), F.count("value").alias("n"))
    years = (F.col("b") - F.col("a")) / F.lit(float(YEAR_LAG[basis]))
    positive = (F.col("first") > 0) & (F.col("last") > 0)
    value = F.when((F.col("n") >= 2) & positive, F.round(F.pow(F.try_divide("last", "first"), F.try_divide(F.lit(1.0), years)) - 1, 9))
    gaps = F.when(F.col("b") - F.col("a") + 1 > F.col("n"), "INTERIOR_GAPS")
    flag = F.when(F.col("n") < 2, "INSUFFICIENT_POINTS").otherwise(F.nullif(F.concat_ws(",", gaps, F.when(~positive, "NON_POSITIVE_ENDPOINT")), F.lit("")))
    return ends.select("series", value.alias("value"), flag.alias("flag"))


def rolling_mean(points: DataFrame, width: int, places: int = 6) -> DataFrame:
    """Mean of the last ``width`` windows; the first width - 1 are left out, an unknown inside gives INCOMPLETE_WINDOW."""
    w = _order()
    frame = w.rowsBetween(1 - width, 0)
    rows = gap_fill(points).select("series", "idx", F.avg("value").over(frame).alias("mean"), F.count("value").over(frame).alias("known"), F.row_number().over(w).alias("n")).filter(F.col("n") >= width)
    whole = F.col("known") == width
    return rows.select("series", "idx", F.when(whole, F.round("mean", places)).alias("value"), F.when(~whole, "INCOMPLETE_WINDOW").alias("flag"))


def rolling_delta(points: DataFrame, width: int, places: int = 6) -> DataFrame:
    """v - v[-width]; the first ``width`` windows are left out."""
    w = _order()
    rows = gap_fill(points).select("series", "idx", (F.col("value") - F.lag("value", width).over(w)).alias("delta"), F.row_number().over(w).alias("n")).filter(F.col("n") > width)
    return rows.select("series", "idx", F.round("delta", places).alias("value"), F.when(F.col("delta").isNull(), "INCOMPLETE_WINDOW").alias("flag"))


def indexed_baseline(points: DataFrame, baseline: int) -> DataFrame:
    """v / v[baseline] * 100; a series whose baseline is missing or zero is one row flagged with the reason, idx NULL."""
    base = F.max(F.when(F.col("idx") == baseline, F.col("value"))).over(Window.partitionBy("series"))
    rows = gap_fill(points).withColumn("base", base)
    bad = F.col("base").isNull() | (F.col("base") == 0)
    good = rows.filter(~bad).select("series", "idx", F.round(F.try_divide("value", "base") * 100, 9).alias("value"), F.when(F.col("value").isNull(), MISSING).alias("flag"))
    errors = rows.filter(bad).select("series", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("double").alias("value"), F.when(F.col("base").isNull(), "MISSING_BASELINE").otherwise(ZERO_BASELINE).alias("flag")).distinct()
    return good.unionByName(errors)


def share(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """parts / wholes of one series and window, for the windows of ``parts``."""
    whole = wholes.select("series", "idx", F.col("value").alias("whole"))
    rows = gap_fill(parts).join(whole, ["series", "idx"], "left")
    flag = F.when(F.col("value").isNull() | F.col("whole").isNull(), MISSING).when(F.col("whole") == 0, ZERO_DENOMINATOR)
    return rows.select("series", "idx", F.round(F.try_divide("value", "whole"), 9).alias("value"), flag.alias("flag"))


def unit_price(amounts: DataFrame, quantities: DataFrame, amount_unit: str, quantity_unit: str) -> DataFrame:
    """As ``share``, with the unit of the result."""
    return share(amounts, quantities).withColumn("unit", F.lit(f"{amount_unit}/{quantity_unit}"))


def before_after(points: DataFrame, at: int, places: int = 6) -> DataFrame:
    """Means of the recorded windows before ``at`` and from it on, and their difference, one row a series."""
    early = F.col("idx") < at
    rows = gap_fill(points).groupBy("series").agg(
        F.avg(F.when(early, F.col("value"))).alias("b"), F.avg(F.when(~early, F.col("value"))).alias("a"), F.count(F.when(early, F.col("value"))).cast("long").alias("n_before"), F.count(F.when(~early, F.col("value"))).cast("long").alias("n_after"), F.count_if(F.col("value").isNull()).alias("missing")
    )
    flag = F.when(F.col("b").isNull() | F.col("a").isNull(), "EMPTY_SIDE").when(F.col("missing") > 0, "EXCLUDED_MISSING")
    return rows.select("series", F.round("b", places).alias("before"), F.round("a", places).alias("after"), F.round(F.col("a") - F.col("b"), places).alias("difference"), "n_before", "n_after", flag.alias("flag"))


def cohort_comparison(points: DataFrame, dimension: str | None = None) -> DataFrame:
    """Each series indexed to its own first non-zero value (= 100). Every window stays: without a value or without such a
    base its result is NULL and flagged.

    With a ``dimension``, series are texts of ``series_key``. Then the whole comparison is refused, every row NULL, if there is
    one series only (TOO_FEW_SERIES) or if a series lacks the dimension (NO_COHORT_DIMENSION).
    """
    first = F.first(F.when(F.col("value") != 0, F.col("value")), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = gap_fill(points).withColumn("index", F.try_divide(F.col("value"), first) * 100).select("series", "idx", F.round("index", 9).alias("value"), F.when(F.col("index").isNull(), MISSING).alias("flag"))
    if dimension is None:
        return rows
    has = F.exists(F.split("series", ","), lambda d: F.startswith(d, F.lit(f"{dimension}=")))
    names = points.filter("idx is not null and series is not null").select("series").distinct()
    refusal = names.agg(F.when(F.count("*") < 2, "TOO_FEW_SERIES").when(~F.every(has), "NO_COHORT_DIMENSION").alias("refusal"))  # one row
    return rows.join(F.broadcast(refusal)).select("series", "idx", F.when(F.col("refusal").isNull(), F.col("value")).alias("value"), F.coalesce("refusal", "flag").alias("flag"))


#: Windows of a pair that one task holds in a row.
STRETCH = 4_096


def lagged_pairs(points: DataFrame, pairs: DataFrame, max_lag: int) -> DataFrame:
    """Pearson correlation of series[t] and reference[t - lag] for every pair (series, reference) and each lag up to
    ``max_lag`` either way: series, reference, lag, pairs, value, flag.

    Points are not joined once a lag: the two series of a pair are laid side by side by window, each window sees the references
    within ``max_lag``, and its products are added by lag before they are shuffled. A long series is cut into stretches that
    share ``max_lag`` windows with their neighbours. Every lag of every pair has a row; repeated pairs count once.
    """
    wide = max(STRETCH, 4 * max_lag)
    named = pairs.select("series", "reference").dropna().distinct()
    known = points.filter("value is not null and idx is not null").select(F.col("series").alias("own"), "idx", "value")
    at = lambda shift: F.floor((F.col("idx") + F.lit(shift)) / F.lit(wide)).cast("long")
    left = named.join(known, F.col("series") == F.col("own")).select("series", "reference", at(0).alias("part"), "idx", F.col("value").alias("x"), F.lit(None).cast("double").alias("y"))
    near = F.explode(F.sequence(at(-max_lag), at(max_lag)))  # the stretches whose windows can see it: two at most
    right = named.join(known, F.col("reference") == F.col("own")).select("series", "reference", near.alias("part"), "idx", F.lit(None).cast("double").alias("x"), F.col("value").alias("y"))
    seen = Window.partitionBy("series", "reference", "part").orderBy("idx").rangeBetween(-max_lag, max_lag)
    rows = left.unionByName(right).withColumn("near", F.collect_list(F.when(F.col("y").isNotNull(), F.struct("idx", "y"))).over(seen)).filter("x is not null")
    products = rows.select("series", "reference", "idx", "x", F.explode("near").alias("other")).select("series", "reference", (F.col("idx") - F.col("other.idx")).cast("int").alias("lag"), "x", F.col("other.y").alias("y"))
    sums = products.groupBy("series", "reference", "lag").agg(F.count("*").alias("pairs"), F.regr_sxy("y", "x").alias("sxy"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"))
    every = named.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
    found = every.join(sums, ["series", "reference", "lag"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    few, flat = F.col("pairs") < 3, (F.col("sxx") == 0) | (F.col("syy") == 0)
    value = F.when(~few & ~flat, F.round(F.try_divide("sxy", F.sqrt(F.col("sxx") * F.col("syy"))), 12))
    return found.select("series", "reference", "lag", "pairs", value.alias("value"), F.when(few, "INSUFFICIENT_PAIRS").when(flat, "ZERO_VARIANCE").alias("flag"))


def lagged_comparison(left: DataFrame, right: DataFrame, max_lag: int) -> DataFrame:
    """``lagged_pairs`` of two series: lag, pairs, value, flag."""
    side = lambda points, name: points.select(F.lit(name).alias("series"), "idx", "value")
    pair = left.sparkSession.createDataFrame([("left", "right")], "series string, reference string")
    return lagged_pairs(side(left, "left").unionByName(side(right, "right")), pair, max_lag).drop("series", "reference")


def control_comparison(points: DataFrame, treated: str, reference: str, at: int) -> DataFrame:
    """The treated series' change around ``at`` less the reference's: one row."""
    change = before_after(points, at)
    one = lambda s, name: change.filter(F.col("series") == s).select(F.col("difference").alias(name))
    both = one(treated, "treated_change").join(one(reference, "reference_change"), how="full", on=F.lit(True))
    return both.select("treated_change", "reference_change", F.round(F.col("treated_change") - F.col("reference_change"), 6).alias("difference"))


def anomaly_candidate(points: DataFrame, threshold: float = 3.5, least: int = 5, *, most: int = MOST) -> DataFrame:
    """Robust z = 0.6745 * (v - median) / MAD for each window; without seasonal adjustment.

    Series under ``least`` points are INSUFFICIENT_POINTS, those with a MAD of zero ZERO_DISPERSION; other windows without a
    value are MISSING_OR_GAP. None is left out. Both medians are exact; no task gathers more than ``most`` values of a series.
    """
    known = points.dropna(subset=["series", "idx", "value"]).select("series", "idx", "value")
    middle = exact_medians(known, most=most)
    off = meet(known, middle.select("series", "middle")).select("series", "idx", F.abs(F.col("value") - F.col("middle")).alias("value"))
    mad = exact_medians(off, most=most).select("series", F.col("middle").alias("mad"))
    rows = meet(gap_fill(points), points.filter("series is not null and idx is not null").select("series").distinct().join(middle, "series", "left").join(mad, "series", "left"))
    few = F.coalesce("n", F.lit(0)) < least
    z = F.when(~few, F.round(F.try_divide(F.lit(0.6745) * (F.col("value") - F.col("middle")), "mad"), 9))
    flag = F.when(few, "INSUFFICIENT_POINTS").when(F.col("mad") == 0, "ZERO_DISPERSION").when(F.col("value").isNull(), MISSING)
    return rows.select("series", "idx", z.alias("z"), F.coalesce(F.abs(z) > threshold, F.lit(False)).alias("candidate"), flag.alias("flag"))


def change_point_candidate(points: DataFrame, segment: int = 3) -> DataFrame:
    """The single split of the recorded windows into two means with the least squared error, the earliest of equal ones.

    One row a series: idx (first window of the later side), score = 1 - SSE / total, before, after, flag.
    """
    w = _order()
    whole = Window.partitionBy("series")
    rows = points.filter("value is not null").withColumn("centre", F.avg("value").over(whole)).withColumn("x", F.col("value") - F.col("centre"))
    run = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("series", "idx", "centre", F.sum("x").over(run).alias("s"), F.sum(F.col("x") * F.col("x")).over(run).alias("q"), F.count("x").over(run).alias("k"), F.sum("x").over(whole).alias("total_s"), F.sum(F.col("x") * F.col("x")).over(whole).alias("total_q"), F.count("x").over(whole).alias("n"))
    later = F.col("n") - F.col("k")
    sse = F.col("q") - F.try_divide(F.col("s") * F.col("s"), F.col("k")) + (F.col("total_q") - F.col("q")) - F.try_divide((F.col("total_s") - F.col("s")) * (F.col("total_s") - F.col("s")), later)
    ok = (F.col("k") >= segment) & (later >= segment)
    score = F.round(1 - F.try_divide(sse, "total_q"), 9)
    place = F.struct((-score).alias("score"), F.col("idx").alias("idx"), F.round(F.col("centre") + F.try_divide("s", "k"), 6).alias("before"), F.round(F.col("centre") + F.try_divide(F.col("total_s") - F.col("s"), later), 6).alias("after"))
    best = rows.groupBy("series").agg(F.max("n").alias("n"), F.max("total_q").alias("total_q"), F.min(F.when(ok & score.isNotNull(), place)).alias("best"))
    flag = F.when(F.col("n") < 2 * segment, "INSUFFICIENT_POINTS").when(F.col("total_q") == 0, "ZERO_DISPERSION")
    return best.select("series", F.col("best.idx").alias("idx"), (-F.col("best.score")).alias("score"), "best.before", "best.after", flag.alias("flag"))


def _spec_hash(spec: dict) -> str:
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def provenance_refs(source_id: str, spec: dict) -> list[str]:
    """What a derived artifact adds to the transformations of its sources: the artifact and the operation with its hash."""
    return [f"artifact:{source_id}", f"temporal-operation:{spec['operation']}@{OPERATION_VERSION}:sha256:{_spec_hash(spec)}"]


def derived_provenance(provenance: DataFrame, source_id: str, spec: dict) -> DataFrame:
    """Provenance rows with ``refs`` ARRAY (NULL: none yet) and those of a derived artifact behind them."""
    own = F.array(*map(F.lit, provenance_refs(source_id, spec)))
    return provenance.withColumn("refs", F.concat(F.coalesce("refs", F.array().cast("array<string>")), own))


def derived_artifact(rows: DataFrame, source_id: str, source_hash: str, spec: dict) -> DataFrame:
    """The result rows of an operation as one header row: id, operation, source and hash, spec_hash, provenance refs, result
    count and period span.

    ``spec``: the whole declaration, its ``operation`` included; keys may come in any order. The id is made of the source's hash
    and the declaration's, so a run again gives the same id and other parameters another. Without results there is no row.
    """
    digest = _spec_hash(spec)
    name = "derived:" + hashlib.sha256(f"{source_hash}|{digest}".encode()).hexdigest()[:32]
    sums = rows.agg(F.count("*").alias("results"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")).filter("results > 0")
    return sums.select(F.lit(name).alias("artifact_id"), F.lit(spec["operation"]).alias("operation"), F.lit(source_id).alias("source_id"), F.lit(source_hash).alias("source_hash"), F.lit(digest).alias("spec_hash"), F.array(*map(F.lit, provenance_refs(source_id, spec))).alias("refs"), "results", "first_idx", "last_idx")
