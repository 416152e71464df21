"""Declarative aggregation of raw text rows: counts, exact sums and means, minima and maxima per period and dimensions.

A value is skipped (blank, NA, null), a number, or invalid, which is counted and never guessed. Sums are exact for all digits
and exponents: values are cut into limbs of six digits (``functions.values.with_number``), whose whole numbers are added by
place, so neither rounding nor partitioning nor the order of merges changes a result. Rows without a period are counted but
not aggregated. An empty table gives no groups.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.values import LIMB, LIMBS, is_blank, is_skipped, with_number

MAX_GROUPS = 100_000


@dataclass(frozen=True)
class Metric:
    """``aggregation``: count, sum, mean, min or max; ``column`` may be None for a count of rows."""

    id: str
    aggregation: str
    column: str | None = None


@dataclass(frozen=True)
class Spec:
    metrics: tuple[Metric, ...]
    dimensions: tuple[str, ...] = field(default=())
    period_column: str | None = None
    period: str | None = None


def parse_values(rows: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """``rows`` with parsed DOUBLE, its exact limbs and status OK, SKIPPED or INVALID, in columns named with ``prefix``."""
    value, limbs = prefix + "parsed", prefix + "limbs"
    own = with_number(rows, F.col(column), value, limbs)
    skipped = is_skipped(F.col(column))
    return own.withColumns({c: F.when(~skipped, F.col(c)) for c in (value, limbs)}).withColumn(prefix + "status", F.when(skipped, "SKIPPED").when(F.col(value).isNull(), "INVALID").otherwise("OK"))


def partials(rows: DataFrame, spec: Spec) -> DataFrame:
    """One row for each period, dimensions and value column: rows, n, total (limbs), low, high, invalid; all can be merged."""
    period = F.trim(F.col(spec.period_column)) if spec.period_column else F.lit(spec.period)
    own = rows.withColumn("period", F.when(~is_blank(period), period)).filter("period is not null")
    columns = list(dict.fromkeys(m.column for m in spec.metrics if m.column)) or [None]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) if c else F.lit(None)).cast("string").alias("cell")) for c in columns])
    long = own.select("period", *spec.dimensions, F.explode(cells).alias("own")).select("period", *spec.dimensions, "own.column", "own.cell")
    parsed = parse_values(long, "cell", "_")
    # A row for the cell itself, whose k is NULL, and one for each limb: added by place before the groups come together.
    every = F.concat(F.array(F.struct(F.lit(None).cast("int").alias("k"), F.lit(0).cast("long").alias("digits"))), F.coalesce("_limbs", F.expr(f"cast(array() as {LIMBS})")))
    keys = ["period", *spec.dimensions, "column"]
    placed = parsed.select(*keys, "_parsed", "_status", F.explode(every).alias("own")).groupBy(*keys, F.col("own.k").alias("k")).agg(
        F.count("*").alias("rows"), F.count("_parsed").alias("n"), F.sum("own.digits").alias("digits"), F.min("_parsed").alias("low"), F.max("_parsed").alias("high"), F.count_if(F.col("_status") == "INVALID").alias("invalid")
    )
    return _gathered(placed, keys)


def _gathered(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a group by place k as one row; those whose k is NULL hold the counts."""
    whole = F.col("k").isNull()
    counted = lambda c: F.coalesce(F.sum(F.when(whole, F.col(c))), F.lit(0)).alias(c)
    total = F.array_sort(F.collect_list(F.when(~whole & (F.col("digits") != 0), F.struct("k", "digits")))).alias("total")
    return placed.groupBy(*keys).agg(counted("rows"), counted("n"), total, F.min("low").alias("low"), F.max("high").alias("high"), counted("invalid"))


def merge_partials(parts: DataFrame, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """Partial rows of several loads as one row a group; order never matters."""
    keys = ["period", *dimensions, "column"]
    every = F.concat(F.array(F.struct(F.lit(None).cast("int").alias("k"), F.lit(0).cast("long").alias("digits"))), F.col("total"))
    placed = parts.withColumn("own", F.explode(every)).groupBy(*keys, F.col("own.k").alias("k")).agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("own.digits").alias("digits"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("invalid").alias("invalid")
    )
    return _gathered(placed, keys)


def _whole(limbs) -> tuple[int, int]:
    """Limbs as (whole, exponent): the number is whole * 10**exponent."""
    if not len(limbs):
        return 0, 0
    least = min(x["k"] for x in limbs)
    return sum(int(x["digits"]) * 10 ** (LIMB * (x["k"] - least)) for x in limbs), LIMB * least


def _nearest(limbs, n: int = 1) -> float | None:
    """The double nearest to the sum of ``limbs`` divided by ``n``."""
    whole, exponent = _whole(limbs)
    try:
        return float(Fraction(whole * 10 ** max(exponent, 0), 10 ** max(-exponent, 0) * n))
    except OverflowError:
        return float("inf") if whole > 0 else float("-inf")


def _rounded(x: float) -> float:
    """To nine places, ties away from zero, as doubles."""
    y = x * 1e9
    if abs(y) >= 2.0**52:  # has no places, or is too large to scale
        return x if y in (float("inf"), float("-inf")) else y / 1e9
    whole = float(int(y))
    if abs(y - whole) >= 0.5:
        whole += 1.0 if y > 0 else -1.0
    return whole / 1e9


@F.pandas_udf(T.DoubleType())
def exact_sum(limbs: pd.Series) -> pd.Series:
    """The double nearest to an exact total."""
    return limbs.map(_nearest)


@F.pandas_udf(T.DoubleType())
def exact_mean(limbs: pd.Series, n: pd.Series) -> pd.Series:
    """The double nearest to an exact total over n, then to nine places."""
    return pd.Series([_rounded(_nearest(x, int(k))) if k else None for x, k in zip(limbs, n, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def exact_text(limbs: pd.Series) -> pd.Series:
    """An exact total as a plain decimal, without an exponent or closing zeros."""

    def text(own) -> str:
        whole, exponent = _whole(own)
        digits = str(abs(whole)).rjust(1 - exponent, "0") if exponent < 0 else str(abs(whole)) + "0" * exponent
        head, part = (digits[:exponent], digits[exponent:].rstrip("0")) if exponent < 0 else (digits, "")
        return ("-" if whole < 0 else "") + (head if whole else "0") + (f".{part}" if part else "")

    return limbs.map(text)


def finish(parts: DataFrame, spec: Spec) -> DataFrame:
    """Partial rows as results: metric_id, period, dimensions, value DOUBLE, rows, n, invalid.

    A sum is the double nearest to the exact total, a mean the one nearest to the exact quotient, to nine places.
    """
    wanted = F.array(*[F.struct(F.lit(m.id).alias("metric_id"), F.lit(m.aggregation).alias("aggregation"), F.lit(m.column).cast("string").alias("of")) for m in spec.metrics])
    valued = parts.withColumn("sum", exact_sum("total")).withColumn("mean", exact_mean("total", "n"))
    rows = valued.withColumn("m", F.explode(wanted))
    only = next((m.column for m in spec.metrics if m.column), None)
    rows = rows.filter(F.col("m.of").eqNullSafe(F.col("column")) | (F.col("m.of").isNull() & F.col("column").eqNullSafe(F.lit(only))))
    kind = F.col("m.aggregation")
    count = F.when(F.col("m.of").isNull(), F.col("rows")).otherwise(F.col("n"))
    value = F.when(kind == "count", count.cast("double")).when(F.col("n") == 0, F.lit(None)).when(kind == "sum", F.col("sum")).when(kind == "mean", F.col("mean")).when(kind == "min", F.col("low")).when(kind == "max", F.col("high"))
    return rows.select("m.metric_id", "period", *spec.dimensions, value.alias("value"), "rows", "n", "invalid")


def prepare_metrics(rows: DataFrame, spec: Spec) -> DataFrame:
    """Results of a specification over raw rows; see ``finish``."""
    return finish(partials(rows, spec), spec)


def flag_results(results: DataFrame) -> DataFrame:
    """Results with flags (NO_VALID_VALUES, UNPARSEABLE_VALUES, joined by commas) and missing where there is no value."""
    flags = F.concat_ws(",", F.when(F.col("n") == 0, "NO_VALID_VALUES"), F.when(F.col("invalid") > 0, "UNPARSEABLE_VALUES"))
    return results.withColumn("missing", F.col("value").isNull()).withColumn("flags", flags)


def group_limit(rows: DataFrame, keys: list[str], limit: int = MAX_GROUPS) -> DataFrame:
    """One row: groups, limit, exceeded. An assertion for callers that promise a bounded result."""
    return rows.select(*keys).distinct().agg(F.count("*").alias("groups")).select("groups", F.lit(limit).alias("limit"), (F.col("groups") > limit).alias("exceeded"))


def input_shape(inputs: DataFrame) -> DataFrame:
    """Per project, from (project, kind, bytes, prepared): counts and bytes of inline documents, raw references and those
    that await preparation."""
    inline, raw = F.col("kind") == "inline", F.col("kind") == "raw"
    size = lambda c: F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0)).cast("long")
    return inputs.groupBy("project").agg(F.count_if(inline).alias("inline_documents"), size(inline).alias("inline_bytes"), F.count_if(raw).alias("raw_references"), size(raw).alias("raw_bytes"), F.count_if(raw & ~F.col("prepared")).alias("awaiting"))
