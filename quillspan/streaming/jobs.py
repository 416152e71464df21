"""Structured Streaming jobs over the same logic as the batch operators.

Each job runs until its input is used up (``availableNow``) or for as long as a trigger says, and keeps its progress in a
checkpoint. Sinks are keyed by batch id, so a batch that runs again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.streaming.state import Deltas, FirstOfId

#: Spark keeps state of several kinds a key in this store only.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys of the ids that an ingest remembers.
ID_BUCKETS = 64


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Jobs that start inside keep their state in the store for keyed state."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def run_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], **trigger) -> None:
    """Runs ``each`` on every micro-batch to the end of the input."""
    job = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    job.awaitTermination()


def stream_ingest(stream: DataFrame, reason, path: str, checkpoint: str, *, id: str | None = None, order: list[str] | None = None, buckets: int = ID_BUCKETS) -> None:
    """Valid rows, rejects with their reason, and a receipt a batch; nothing shows before its batch is whole.

    With ``id`` the first valid row of an id stays, over all batches, and later ones are rejected as a duplicate id; inside a
    batch the first in ``order``. Blank ids are never duplicates, and rejected rows do not take an id. Ids are remembered in
    keyed state, ``buckets`` keys, so a batch that runs again after a failure gives the same rows.
    """
    marked = stream.withColumn("reason", reason)
    if id is not None:
        plain = F.coalesce(F.trim(F.col(id).cast("string")), F.lit(""))
        taken = F.col("reason").isNull() & (plain != "")
        # Rows that take no id go to any bucket.
        bucket = F.pmod(F.when(taken, F.xxhash64(plain)).otherwise(F.xxhash64(*stream.columns)), F.lit(buckets)).alias("_bucket")
        keyed = marked.select("*", F.when(taken, plain).alias("_id"), bucket)
        marked = keyed.groupBy("_bucket").transformWithState(FirstOfId(marked.columns, list(order or stream.columns)), marked.schema, "Append", "None")

    def each(batch: DataFrame, number: int) -> None:
        own = batch.persist()
        own.filter("reason is null").drop("reason").write.mode("overwrite").parquet(f"{path}/valid/batch={number}")
        own.filter("reason is not null").write.mode("overwrite").parquet(f"{path}/rejects/batch={number}")
        own.agg(F.count("*").alias("read"), F.count("reason").alias("skipped")).write.mode("overwrite").parquet(f"{path}/receipts/batch={number}")
        own.unpersist()

    with keyed_state(stream.sparkSession):
        run_batches(marked, checkpoint, each)


def stream_rollup(stream: DataFrame, time: str, keys: list[str], value: str, width: str, late: str, path: str, checkpoint: str) -> None:
    """Counts and exact sums per window and keys. Sums commute, so the order of arrival never matters; the watermark bounds
    the state and drops rows later than ``late``."""
    groups = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"))

    def each(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("start"), *keys, "n", "total").write.mode("overwrite").parquet(f"{path}/batch={number}")

    job = groups.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()


def latest_of(batches: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key over the batches (…, batch) of an update sink."""
    others = [c for c in batches.columns if c not in (*keys, "batch")]
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, "last.*")


DELTAS = "series string, at timestamp, id long, value double, kind string, delta double, restated double, step long"
NAN = float("nan")


def stream_observation_delta(stream: DataFrame, path: str, checkpoint: str, *, id: str | None = None, width_seconds: int = 86_400, history: int = 4_000) -> None:
    """Each observation (series, at, value) against the latest earlier one of its series, in whatever order they arrive.

    With ``id``, a column of whole numbers, observations of one time and different ids are several, in the order of their ids, and
    each is compared with the one before; without it a series has one observation a time.

    kind: FIRST without an earlier one, DELTA, RESTATED at a time that the series has already (``restated``: the change from the
    former value), CORRECTED for the next later observation, whose delta a late or restated one changes. ``delta`` is the
    change from the latest earlier time. The last row of a (series, at, id) by batch and ``step`` is its final one and does not
    depend on the order of arrival, unless one of them has several values: then the last to arrive stays, of one batch the largest.

    A series' observations are keyed state, in buckets of ``width_seconds``; the newest ``history`` buckets are kept. An
    observation older than these is TOO_LATE and compared with nothing. Rows without a series, time, id or value are left out. A
    batch that runs again after a failure starts from the same state and replaces its rows.
    """
    own = stream.select(F.col("series").cast("string").alias("series"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), (F.lit(0) if id is None else F.col(id)).cast("long").alias("id"), F.col("value").cast("double").alias("value")).dropna()
    # Frames leave a task one by one; of plain rows, Spark would gather all of a key.
    found = own.groupBy("series").transformWithStateInPandas(Deltas(width_seconds * 1_000_000, history), DELTAS.replace("timestamp", "long") + ", compared boolean", "Append", "None")
    # A frame has no NULL apart from NaN.
    delta = F.when(F.col("compared"), F.coalesce("delta", F.lit(NAN)))
    restated = F.when(F.col("kind") == "RESTATED", F.coalesce("restated", F.lit(NAN)))

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumns({"at": F.timestamp_micros("at"), "delta": delta, "restated": restated}).drop("compared").write.mode("overwrite").parquet(f"{path}/batch={number}")

    with keyed_state(stream.sparkSession):
        run_batches(found, checkpoint, each)


def final_deltas(found: DataFrame) -> DataFrame:
    """(series, at, value, delta) of each observation, from the rows of all batches of ``stream_observation_delta``."""
    last = found.filter("kind <> 'TOO_LATE'").groupBy("series", "at", "id").agg(F.max_by(F.struct("value", "delta"), F.struct("batch", "step")).alias("last"))
    return last.select("series", "at", "last.*")


def stream_scenario_status(stream: DataFrame, expectations: DataFrame, path: str, checkpoint: str) -> None:
    """Indicator observations (key, at, outcome) against static expectations (scenario_id, key, window_start, window_end,
    frozen_at): partial counts a batch; ``scenario_states`` adds them up, so earlier observations are carried forward.
    Decisive outcomes outside the window or not after the freeze are inconclusive; other outcomes that are no INCONCLUSIVE
    count nothing."""

    def each(batch: DataFrame, number: int) -> None:
        # Observations of one key and time are counted first, so an expectation meets few rows however many there are.
        hit = batch.groupBy("key", "at", "outcome").agg(F.count("*").alias("k")).join(expectations, "key")
        inside = (F.col("at") >= F.col("window_start")) & (F.col("at") <= F.col("window_end")) & (F.col("at") > F.col("frozen_at"))
        decisive = F.col("outcome").isin("CONTRADICTS", "CONSISTENT")
        times = lambda when: F.coalesce(F.sum(F.when(when, F.col("k"))), F.lit(0))
        counts = hit.groupBy("scenario_id").agg(times(inside & (F.col("outcome") == "CONTRADICTS")).alias("against"), times(inside & (F.col("outcome") == "CONSISTENT")).alias("fits"), times((F.col("outcome") == "INCONCLUSIVE") | (decisive & ~inside)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_batches(stream, checkpoint, each)


def scenario_states(counts: DataFrame, expectations: DataFrame, weakened: DataFrame) -> DataFrame:
    """(scenario_id, status) from the partial counts of all batches; ``weakened``: scenario_id of those whose latest check of
    an assumption says INVALIDATED."""
    total = counts.groupBy("scenario_id").agg(F.sum("against").alias("a"), F.sum("fits").alias("f"), F.sum("n").alias("n"))
    rows = expectations.select("scenario_id").distinct().join(total, "scenario_id", "left").join(weakened.select("scenario_id", F.lit(True).alias("weak")).distinct(), "scenario_id", "left")
    status = F.when(F.col("a") > 0, "CONTRADICTED").when(F.col("weak"), "WEAKENED").when(F.col("f") > 0, "CONSISTENT_SO_FAR").when(F.col("n") > 0, "INCONCLUSIVE").otherwise("UNTESTED")
    return rows.select("scenario_id", status.alias("status"))