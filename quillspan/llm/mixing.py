"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source is cut into blocks. With weight w of a total W, block b of a source is released at slot floor(b * W / w) and due
by slot ceil((b + 1) * W / w), from the whole weights, without rounding. Earliest deadline first among the released blocks
meets every deadline, so at every slot each source has had its weight's share to within less than one block.

The schedule is worked out for all blocks at once, for any number of sources. Which slots the blocks with the earlier half
of the deadlines fill does not depend on the others, nor on the order among them: served first come, first served, they
fill the same slots. So the blocks are split by deadline again and again, each half with its own slots, until a part is
small enough to be folded in one row. Ranks and running maxima are taken by ranges of slots with what came before carried
over, so no task holds the whole schedule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import cut

BLOCK_ROWS = 32
#: Blocks that one row folds, at most; slots of a range.
LEAF, RANGE = 256, 65_536
_PREFIX = 3  # hex digits of a row's hash that split the rows of a source, so that no source is ranked in one task


def _ranked(rows: DataFrame, at: str, order: str, name: str) -> DataFrame:
    """``rows`` with the range of ``at`` and their rank in their node by (``at``, ``order``), from 0."""
    rows = rows.withColumn("range", F.expr(f"{at} div {RANGE}"))
    sizes = rows.groupBy("node", "range").agg(F.count("*").alias("n"))
    before = sizes.select("node", "range", (F.sum("n").over(Window.partitionBy("node").orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("node", "range").orderBy(at, order))
    return rows.join(before, ["node", "range"]).withColumn(name, F.col("before") + place - 1).drop("before")


def _served(jobs: DataFrame) -> DataFrame:
    """(node, k, served): the slots that the jobs (node, at, turn) of a node fill, first come, first served."""
    ranked = _ranked(jobs.select("node", "at", "turn"), "at", "turn", "k").withColumn("lead", F.col("at") - F.col("k"))
    tops = ranked.groupBy("node", "range").agg(F.max("lead").alias("top"))
    earlier = Window.partitionBy("node").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("node", "range", F.max("top").over(earlier).alias("top"))
    here = Window.partitionBy("node", "range").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.join(tops, ["node", "range"]).select("node", "k", (F.col("k") + F.greatest("top", F.max("lead").over(here))).alias("served"))


def _counted(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` (node, at) with how many ``marks`` (node, served) of their node lie before ``at``, and whether one is there."""
    every = rows.withColumn("mark", F.lit(0)).unionByName(marks.select("node", F.col("served").alias("at"), F.lit(1).alias("mark")), allowMissingColumns=True)
    every = every.withColumn("range", F.expr(f"at div {RANGE}"))
    sums = every.groupBy("node", "range").agg(F.sum("mark").alias("n"))
    before = sums.select("node", "range", (F.sum("n").over(Window.partitionBy("node").orderBy("range")) - F.col("n")).alias("before"))
    here = Window.partitionBy("node", "range").orderBy("at")
    less = F.coalesce(F.sum("mark").over(here.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.max("mark").over(here.rangeBetween(0, 0)) == 1
    return every.withColumn("less", less).withColumn("taken", taken).join(before, ["node", "range"]).withColumn("less", F.col("less") + F.col("before")).filter("mark = 0").drop("mark", "range", "before")


def _parts(jobs: DataFrame, n: int, leaf: int) -> DataFrame:
    """Jobs and slots of parts of ``leaf`` jobs at most: (node, size, at, turn, source, block, slot).

    A row with a slot is the slot of its node at place ``at``; one without is a job that is released at place ``at`` of its
    node and is the ``turn``-th by deadline. Every node has as many slots as jobs.
    """
    slots = _served(jobs)
    # The jobs fill some slots of the time line; places are counted among these.
    own = _counted(jobs, slots).select("node", F.lit(n).cast("long").alias("size"), F.col("less").alias("at"), "turn", "source", "block", F.lit(None).cast("long").alias("slot"))
    none = F.lit(None).cast("long")
    rows = own.unionByName(slots.select("node", F.lit(n).cast("long").alias("size"), F.col("k").alias("at"), none.alias("turn"), F.lit(None).cast("string").alias("source"), none.alias("block"), F.col("served").alias("slot")))
    most = n
    while most > leaf:
        rows = cut(rows, "mix-parts")
        half = F.expr("(size + 1) div 2")
        marked = _counted(rows, _served(rows.filter(F.col("slot").isNull() & (F.col("turn") < half))))
        first = F.when(F.col("slot").isNull(), F.col("turn") < half).otherwise(F.col("taken"))
        rows = marked.select(
            (F.col("node") * 2 + F.when(first, 0).otherwise(1)).alias("node"),
            F.when(first, half).otherwise(F.col("size") - half).alias("size"),
            F.when(first, F.col("less")).otherwise(F.col("at") - F.col("less")).alias("at"),
            F.when(first, F.col("turn")).otherwise(F.col("turn") - half).alias("turn"),
            "source",
            "block",
            "slot",
        )
        most = (most + 1) // 2
    return rows


def schedule(sources: DataFrame, total: int, *, leaf: int = LEAF) -> DataFrame:
    """(source, block, release, deadline, slot) for every block, by earliest deadline first.

    ``sources``: source, weight, blocks, one row a source, with positive weights that sum to ``total`` or less. Equal
    deadlines go by the source's name. Slots in which no block is released stay empty.
    """
    many = sources.withColumn("run", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {RANGE})"))).repartition("source", "run")
    jobs = many.withColumn("block", F.explode(F.expr(f"sequence(run * {RANGE}, least(blocks, (run + 1) * {RANGE}) - 1)")))
    whole = f"cast({int(total)} as decimal(19, 0))"
    windows = jobs.select(
        "source",
        "block",
        F.expr(f"cast(block as decimal(19, 0)) * {whole} div weight").alias("release"),
        F.expr(f"(cast(block + 1 as decimal(19, 0)) * {whole} + weight - 1) div weight").alias("deadline"),
    )
    jobs = cut(_ranked(windows.withColumn("node", F.lit(0).cast("long")), "deadline", "source", "turn").drop("range"), "mix-jobs")
    n = jobs.count()
    parts = _parts(jobs.withColumn("at", F.col("release")).drop("release", "deadline"), n, leaf)
    by_place = F.array_sort(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("at", "slot"))))
    by_turn = F.array_sort(F.collect_list(F.when(F.col("slot").isNull(), F.struct("turn", "at", "source", "block"))))
    fold = """
        aggregate(
          sequence(0L, size(slots) - 1L),
          named_struct('left', jobs, 'done', cast(array() as array<struct<source:string,block:bigint>>)),
          (s, t) -> aggregate(
            array(element_at(filter(s.left, x -> x.at <= t), 1)),
            s,
            (s, c) -> named_struct('left', filter(s.left, x -> x.turn <> c.turn),
                                   'done', concat(s.done, array(named_struct('source', c.source, 'block', c.block))))),
          s -> s.done)"""
    parts = parts.groupBy("node").agg(by_place.alias("slots"), by_turn.alias("jobs"))
    placed = parts.select("slots", F.posexplode(F.expr(fold)).alias("place", "own")).select("own.source", "own.block", F.expr("slots[place].slot").alias("slot"))
    return jobs.select("source", "block", "release", "deadline").join(placed, ["source", "block"])


def mix(docs: DataFrame, weights: DataFrame, *, block_rows: int = BLOCK_ROWS, leaf: int = LEAF) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, source; other columns are not read): doc_id, source, block, release,
    deadline, slot, position.

    ``weights``: source, weight (a positive whole number); repeated rows of a source add up. Every source of ``docs`` must
    have a weight, else a ValueError names how many have none. Ordered by ``position`` the rows have the target weights at
    every block to within less than one block, for as long as no source is used up; after that, the slots of used-up sources
    close up and the rest keep their weights among themselves. No row is dropped or repeated. A source's rows follow each
    other by the MD5 of their id, so a block is no run of neighbouring ids. A null source is a source named ''; null ids come
    first in it; repeated rows stay; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.col("source").alias("named"), F.coalesce(F.col("source"), F.lit("")).alias("source"), F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("")).alias("hash"))
    rows = rows.withColumn("part", F.substring("hash", 1, _PREFIX))
    counts = rows.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = counts.select("source", "part", (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("own", F.row_number().over(Window.partitionBy("source", "part").orderBy("hash", "doc_id")) - 1)
    numbered = ranked.join(before, ["source", "part"]).withColumn("row", F.col("before") + F.col("own")).withColumn("block", F.expr(f"row div {int(block_rows)}"))
    shares = weights.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("source")).agg(F.sum(F.when(F.col("weight") > 0, F.col("weight").cast("long"))).alias("weight"))
    blocks = counts.groupBy("source").agg(F.expr(f"(sum(n) + {int(block_rows) - 1}) div {int(block_rows)}").alias("blocks"))
    sources = cut(shares.join(blocks, "source", "full"), "mix-sources")
    total, unknown = sources.agg(F.sum("weight"), F.count_if(F.col("weight").isNull())).first()
    if unknown:
        raise ValueError(f"{unknown} sources without a positive weight")
    plan = schedule(sources.filter("blocks > 0"), total or 1, leaf=leaf)
    return numbered.join(plan, ["source", "block"]).select(
        "doc_id",
        F.col("named").alias("source"),
        "block",
        "release",
        "deadline",
        "slot",
        F.expr(f"slot * {int(block_rows)} + row % {int(block_rows)}").alias("position"),
    )


def root_weights(docs: DataFrame) -> DataFrame:
    """Weights that flatten the sources: the whole part of the square root of each source's rows, one at least. A null source is
    the source ''; repeated rows count each; other columns are not read; an empty table has no weights."""
    return docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("source")).agg(F.floor(F.sqrt(F.count("*"))).cast("long").alias("weight"))


def in_mixed_order(docs: DataFrame, weights: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs``, all rows and columns, dealt to partitions by position and sorted, so that files hold the mixture in order.

    Rows of one id and source stand at the first of their places, in any order; nulls, ties and empty tables are as in
    ``mix``; columns may have any names.
    """
    taken = "mix"
    while any(c.startswith(taken) for c in docs.columns):
        taken += "_"
    order = mix(docs, weights, block_rows=block_rows)
    spots = order.groupBy(F.col("doc_id").alias(taken + "id"), F.coalesce(F.col("source"), F.lit("")).alias(taken + "source")).agg(F.min("position").alias(taken + "at"))
    same = docs["doc_id"].eqNullSafe(spots[taken + "id"]) & (F.coalesce(docs["source"], F.lit("")) == spots[taken + "source"])
    return docs.join(spots, same).repartitionByRange(F.col(taken + "at")).sortWithinPartitions(taken + "at").select(*[docs[c] for c in docs.columns])
