"""What the operators of this subpackage share: shared folders, folds, text normalisation and averages of models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.shared import shared_path

#: The ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
SLICES, GROUP = 16, 32  # slices of a model's weights; tasks whose weights are averaged first
#: Bytes of a column, at most about, that a task makes Python objects of at once.
HELD = 4_000_000
PART = "slice int, grp int, weight double, part binary"


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once to a new table in the shared folder and read back: it ends the lineage and survives lost
    executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = HELD) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of ``column``, so that what a task makes of a slice does not grow with the
    rows of a batch. A batch without rows is a slice."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
        at = [0, *ends.tolist(), len(batch)]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield batch.slice(a, b - a)


def shards(spark: SparkSession) -> int:
    """How many parts a salted key is dealt to: four for each shuffle partition, so that parts even out."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as fold -1, which belongs to no held-out part."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(-1)).cast("int")


def sliced(values: np.ndarray, weight: float) -> pa.RecordBatch:
    """A task's float32 values and their weight, in slices for ``averaged``; rows of ``PART``."""
    group = TaskContext.get().partitionId() // GROUP
    cuts = [c.tobytes() for c in np.array_split(values.astype(np.float32, copy=False), SLICES)]
    columns = [pa.array(range(SLICES), pa.int32()), pa.array([group] * SLICES, pa.int32()), pa.array([float(weight)] * SLICES), pa.array(cuts, pa.binary())]
    return pa.record_batch(columns, names=["slice", "grp", "weight", "part"])


def _averages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for i, n, part in zip(*(batch.column(c).to_pylist() for c in ("slice", "weight", "part")), strict=True):
            own = sums.setdefault(i, [0.0, 0.0])
            own[0] += n
            own[1] = own[1] + n * np.frombuffer(part, np.float32).astype(np.float64)
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()]), pa.array([(s[1] / s[0]).astype(np.float32).tobytes() for s in sums.values()], pa.binary())], names=["slice", "weight", "part"])


def averaged(parts: DataFrame) -> tuple[np.ndarray, float]:
    """The weighted mean of the tasks' values (see ``sliced``), and the sum of the weights; no values and 0 without tasks."""
    schema = "slice int, weight double, part binary"
    few = parts.repartition("slice", "grp").drop("grp").mapInArrow(_averages, schema)  # so no task meets all tasks' values
    found = sorted(few.repartition(SLICES, "slice").mapInArrow(_averages, schema).collect(), key=lambda r: r.slice)
    values = [np.frombuffer(bytes(r.part), np.float32) for r in found]
    return (np.concatenate(values), found[0].weight) if found else (np.zeros(0, np.float32), 0.0)
