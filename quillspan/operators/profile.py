"""Profiles of text tables, column types and rule-based triage of variables.

A profile has one row a column, over cells without outer white space. Samples are the smallest distinct values, not the
first in file order, so partitions never change them. Empty tables give EMPTY columns with zero counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.values import NUMBER, is_blank, is_date, tokens

#: A set of distinct hashes is exact up to 2**EXACT of them, which is beyond MAX_DISTINCT, and bounded beyond.
EXACT, SPACE = 14, " \t\n\x0b\x0c\r"
MAX_DISTINCT, SAMPLES, SAMPLE_CHARS, MAX_DIMENSION = 10_000, 5, 64, 50
#: Names of period columns.
PERIODS = ("year", "month", "date", "period", "fy", "quarter", "week", "day")


def _trimmed(name: str) -> Column:
    return F.trim(F.col(f"`{name}`").cast("string"), F.lit(SPACE))


def cells(rows: DataFrame) -> DataFrame:
    """(position, name, cell) of every cell of ``rows`` as text without outer white space."""
    every = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), _trimmed(c).alias("cell")) for i, c in enumerate(rows.columns)])
    return rows.select(F.explode(every).alias("own")).select("own.*")


def _type(long: DataFrame) -> list[Column]:
    known = ~is_blank(F.col("cell"))
    plain = F.col("cell")
    num = plain.rlike(NUMBER)
    whole = plain.rlike(r"^[+-]?[0-9]+$") & plain.try_cast("bigint").isNotNull()  # longer ones are numbers
    every = lambda c: F.every(F.when(known, c))
    return [
        F.when(F.count_if(known) == 0, "EMPTY").when(every(is_date(plain)) & ~every(num), "DATE").when(every(whole), "INTEGER").when(every(num), "NUMBER").when(every(F.lower(plain).isin("true", "false")), "BOOLEAN").otherwise("STRING").alias("type")
    ]


def infer_types(rows: DataFrame) -> DataFrame:
    """(position, name, type): EMPTY, DATE, INTEGER, NUMBER, BOOLEAN or STRING, in that order of precedence."""
    long = cells(rows)
    return long.groupBy("position", "name").agg(*_type(long))


def _least(columns: list[str]):
    """The smallest distinct values of each column of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.array([], pa.string()) for _ in columns]
        for batch in batches:
            for i, column in enumerate(batch.columns):
                own = pc.unique(pa.chunked_array([held[i], column.drop_null().cast(pa.string())]))
                held[i] = own.take(pc.array_sort_indices(own)[:SAMPLES])
        places = [i for i, own in enumerate(held) for _ in own]
        yield pa.record_batch([pa.array(places, pa.int32()), pa.concat_arrays(held) if held else pa.array([], pa.string())], names=["position", "v"])

    return run


@F.pandas_udf(T.StringType())
def shortest(numbers: pd.Series) -> pd.Series:
    """The shortest decimal that names a double, without an exponent."""

    def text(x: float) -> str | None:
        if pd.isna(x):
            return None
        plain = format(Decimal(repr(float(x))), "f")
        return plain.removesuffix(".0") if "." in plain else plain

    return numbers.map(text)


def profile_table(rows: DataFrame) -> DataFrame:
    """One row a column: position, name, type, non_null, nulls, distinct_values, capped, low, high, samples.

    Distinct values are counted by a mergeable sketch of the smallest hashes, which is exact up to ``MAX_DISTINCT``, and samples
    are the tasks' smallest values merged; so what is shuffled is a few rows a column and task, however many values there are.
    Minima and maxima of numbers are the shortest decimals.
    """
    long = cells(rows)
    known = ~is_blank(F.col("cell"))
    v = F.when(known, F.col("cell"))
    number = F.when(v.rlike(NUMBER), v.try_cast("double"))
    facts = long.groupBy("position", "name").agg(
        *_type(long), F.count(v).alias("non_null"), F.count_if(~known).alias("nulls"), F.theta_sketch_agg(v, EXACT).alias("sketch"), F.min(number).alias("low_n"), F.max(number).alias("high_n"), F.min(v).alias("low_s"), F.max(v).alias("high_s")
    )
    wide = rows.select(*[F.when(~is_blank(_trimmed(c)), _trimmed(c)).alias(f"c{i}") for i, c in enumerate(rows.columns)])
    least = wide.mapInArrow(_least(wide.columns), "position int, v string").distinct()
    firsts = least.withColumn("r", F.row_number().over(Window.partitionBy("position").orderBy("v"))).filter(F.col("r") <= SAMPLES)
    samples = firsts.groupBy("position").agg(F.array_join(F.array_sort(F.collect_list(F.substring("v", 1, SAMPLE_CHARS))), "|").alias("samples"))
    numeric = F.col("type").isin("INTEGER", "NUMBER")
    end = lambda a, b: F.when(numeric, shortest(a)).when(F.col("type").isin("DATE", "STRING"), F.substring(F.col(b), 1, SAMPLE_CHARS))
    found = F.coalesce(F.theta_sketch_estimate("sketch"), F.lit(0))
    return facts.join(samples, "position", "left").select("position", "name", "type", "non_null", "nulls", F.least(found, F.lit(MAX_DISTINCT)).cast("long").alias("distinct_values"), (found > MAX_DISTINCT).alias("capped"), end("low_n", "low_s").alias("low"), end("high_n", "high_s").alias("high"), F.coalesce("samples", F.lit("")).alias("samples"))


def profile_fingerprint(profile: DataFrame) -> DataFrame:
    """One row: SHA-256 of the profile's rows in order, counts of rows included; equal data give equal prints."""
    line = F.concat_ws("\u001f", F.lpad(F.col("position").cast("string"), 6, "0"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("name", "type", "non_null", "nulls", "distinct_values", "low", "high", "samples")])
    return profile.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("fingerprint"))


def link_gap_tokens(columns: DataFrame, gaps: DataFrame) -> DataFrame:
    """(name, gap_id) where a token of the column's name and one of the gap's need are equal or one begins the other, four
    characters at least. Joined by the first four characters, so no cross join is needed."""
    own = columns.select("name", F.explode(tokens(F.col("name"))).alias("t")).distinct()
    need = gaps.select("gap_id", F.explode(tokens(F.col("need"))).alias("g")).distinct()
    stem = lambda c: F.substring(c, 1, 4)
    same = (stem("t") == stem("g")) & ((F.col("t") == F.col("g")) | ((F.length("t") >= 4) & (F.length("g") >= 4) & (F.col("t").startswith(F.col("g")) | F.col("g").startswith(F.col("t")))))
    return own.join(need, same).select("name", "gap_id").distinct()


def triage_columns(profile: DataFrame, question: str, gaps: DataFrame, row_count: int) -> DataFrame:
    """A decision a column: name, bucket (INCLUDE, DEFER, NEEDS_REVIEW), role, gaps. A linked gap promotes to INCLUDE."""
    linked = link_gap_tokens(profile, gaps).groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("gap_id")), ",").alias("gaps"))
    rows = profile.join(linked, "name", "left").withColumn("own", tokens(F.col("name"))).withColumn("asked", tokens(F.lit(question)))
    kind = F.col("type")
    period = F.size(F.array_intersect("own", F.array(*[F.lit(p) for p in PERIODS]))) > 0
    overlap = F.exists("own", lambda k: F.exists("asked", lambda q: F.contains(q, k)))
    numeric = kind.isin("INTEGER", "NUMBER")
    is_period = (kind == "DATE") | ((kind == "INTEGER") & period)
    identifier = (kind == "STRING") & (F.lit(row_count) > MAX_DIMENSION) & (F.col("distinct_values") >= row_count)
    dimension = kind.isin("STRING", "BOOLEAN") & (F.col("distinct_values") <= MAX_DIMENSION) & ~F.col("capped")
    hit = overlap | F.col("gaps").isNotNull() | (F.size("asked") == 0)
    bucket = F.when(kind == "EMPTY", "NEEDS_REVIEW").when(is_period, "INCLUDE").when(numeric, F.when(hit, "INCLUDE").otherwise("DEFER")).when(identifier, "DEFER").when(dimension, "INCLUDE").otherwise("NEEDS_REVIEW")
    role = F.when(kind == "EMPTY", None).when(is_period, "PERIOD").when(numeric, "METRIC").when(identifier, "IDENTIFIER").when(dimension, "DIMENSION")
    promoted = F.when(F.col("gaps").isNotNull() & (kind != "EMPTY"), "INCLUDE").otherwise(bucket)
    return rows.select("name", promoted.alias("bucket"), role.alias("role"), F.coalesce("gaps", F.lit("")).alias("gaps"))


def normalize_plan(profile: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, errors): every profiled column (position, name) once; decisions (ord, name, bucket, by_human) for unknown
    columns are errors. The first of repeated decisions counts, none is NEEDS_REVIEW, and EXCLUDE needs a human."""
    first = decisions.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("ord"))).filter("r = 1")
    bucket = F.when(F.col("bucket").isNull(), "NEEDS_REVIEW").when((F.col("bucket") == "EXCLUDE") & ~F.coalesce("by_human", F.lit(False)), "DEFER").otherwise(F.col("bucket"))
    plan = profile.select("position", "name").join(first.select("name", "bucket", "by_human"), "name", "left").select("position", "name", bucket.alias("bucket"))
    return plan, decisions.join(profile, "name", "left_anti").select("ord", "name")


def revise_plan(plan: DataFrame, moves: DataFrame) -> DataFrame:
    """A plan (name, bucket) after ordered moves (ord, name, to_bucket): name, from_bucket, bucket; the last move counts and
    from_bucket is what stood before it."""
    w = Window.partitionBy("name").orderBy("ord")
    steps = moves.withColumn("came", F.lag("to_bucket").over(w)).groupBy("name").agg(F.max_by(F.struct("to_bucket", "came"), "ord").alias("last"))
    moved = F.col("last").isNotNull()
    return plan.join(steps, "name", "left").select("name", F.when(moved, F.coalesce("last.came", "bucket")).alias("from_bucket"), F.coalesce("last.to_bucket", "bucket").alias("bucket"))


def diff_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns whose bucket differs: name, old_bucket, new_bucket."""
    a, b = old.select("name", F.col("bucket").alias("old_bucket")), new.select("name", F.col("bucket").alias("new_bucket"))
    return a.join(b, "name").filter(~F.col("old_bucket").eqNullSafe(F.col("new_bucket")))


def merge_gap_refs(refs: DataFrame) -> DataFrame:
    """Gap references (ord, gap_id, need, dimension) by id: the first non-blank need and all dimensions."""
    need = F.when(F.trim("need") != "", F.col("need"))
    merged = refs.groupBy("gap_id").agg(F.min_by(need, F.when(need.isNotNull(), F.col("ord"))).alias("need"), F.array_join(F.array_sort(F.collect_set("dimension")), ",").alias("dimensions"))
    return merged.select("gap_id", F.coalesce("need", F.lit("")).alias("need"), "dimensions")
