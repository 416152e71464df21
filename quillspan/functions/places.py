"""Places of rows in the order of their group, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(rows: DataFrame, by: list[str], stretch: list[Column], order: list, name: str = "pos") -> DataFrame:
    """``rows`` with their place from 1 in the group ``by``, in the order of ``stretch`` and then ``order``.

    Rows are ranked within their stretch, a part of the group such as a day; a stretch's first place comes from the counts of
    the stretches before it, so a group that holds a third of all rows is ranked in many tasks. Nulls come first and are equal.
    """
    own = rows.withColumn("_stretch", F.struct(*[c.alias(f"s{i}") for i, c in enumerate(stretch)]))
    counts = own.groupBy(*by, "_stretch").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias("_" + c) for c in by], F.col("_stretch").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_stretch").eqNullSafe(F.col("_at"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col("_" + c))
    place = F.row_number().over(Window.partitionBy(*by, "_stretch").orderBy(*order))
    return own.withColumn("_place", place).join(starts, same).withColumn(name, (F.col("_before") + F.col("_place")).cast("int")).select(*rows.columns, name)
