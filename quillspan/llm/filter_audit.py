"""Filter interaction audit: what each filter removes in each order, from the coalitions of a removal game.

A document's *mask* holds a bit for each filter that it fails. The documents that a set S of filters removes are those whose
mask meets S: the game v(S). Its Hart-Mas-Colell potential is P({}) = 0 and

    P(S) = (v(S) + sum over i in S of P(S without i)) / |S|,

worked out once for each coalition. A filter's Shapley value is P(all) - P(all without it). What a step removes is a
difference of two coalitions, v(before and filter) - v(before), so no order is replayed over the documents: they are read
once and counted by part and mask.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import cut

#: Filters at most: their orders grow with the factorial.
MOST = 6
_SPACED = r"([^\x20\x09-\x0D]+)"


def text_failures(text: Column) -> list[Column]:
    """Filters A to D over a text: under 200 words; under half of the words distinct; over 3 % of A-Z; a sign of ``#$%&*|``."""
    words = F.regexp_extract_all(text, F.lit(_SPACED), F.lit(1))
    n = F.size(words).cast("long")
    return [
        n < 200,
        F.size(F.array_distinct(words)).cast("long") * 100 < n * 50,
        F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * 3,
        text.rlike("[#$%&*|]"),
    ]


def fail_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) for every row of ``docs`` (doc_id, text, lang; other columns are not read).

    Bits 0 to 3 are ``text_failures``, bit 4 a text that a smaller doc_id has too, anywhere in the table. A null text is
    empty, a null lang the part ''. A null id is greater than every other; rows of one id and text do not fail for each other.
    ``labels`` (doc_id, quality, toxic): a document with several rows is good or toxic if one of them says so; without a row
    it is neither. Empty tables give an empty result.

    Texts are compared by their SHA-256. Only the row with the least id of a text has a partner in the join by (text, id), so
    a text that fills a third of all rows is dealt evenly.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mask = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(text_failures(text))), F.lit(0))
    own = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), mask.alias("mask")),
        "audit-masks",
    )
    least = own.groupBy(F.col("sha").alias("first_sha")).agg(F.min("doc_id").alias("first_id"))
    is_first = (F.col("sha") == F.col("first_sha")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return (
        own.join(least, is_first, "left")
        .join(marks, F.col("doc_id") == F.col("label_id"), "left")
        .select("part", (F.col("mask") + F.when(F.col("first_sha").isNull(), 16).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    )


def _game(field: str, full: int) -> Column:
    """v(S) of each coalition S, as an array with S as its index."""
    return F.expr(f"transform(sequence(0, {full}), s -> aggregate(cells, 0L, (a, c) -> a + if(c.mask & s <> 0, c.{field}, 0L)))")


def _potential(n: int, full: int) -> Column:
    """n! times the potential of each coalition, always a whole number: a coalition comes after all its parts."""
    less = f"aggregate(filter(sequence(0, {n - 1}), i -> s & shiftleft(1, i) <> 0), 0L, (a, i) -> a + p[s - shiftleft(1, i)])"
    return F.expr(f"aggregate(sequence(1, {full}), array(0L), (p, s) -> concat(p, array(({math.factorial(n)}L * removal[s] + {less}) div bit_count(s))))")


def audit(masks: DataFrame, filters: str) -> DataFrame:
    """One row for each part, order of ``filters`` (one letter each, six at most) and step, zeros included.

    ``masks``: part, mask (bit i: the document fails filter i), good, toxic. Returns part, filter_order, step, kept (after the
    step), removed (here), redundant (failing this filter, removed earlier), unique_fails (failing this filter only), good_lost
    and toxic_lost (of those removed here) and shapley: what the filter removes, summed over all orders. An empty table has no
    parts and gives an empty result.
    """
    n = len(filters)
    if not 0 < n <= MOST or len(set(filters)) < n:
        raise ValueError(f"1 to {MOST} different letters are needed, not {filters!r}")
    full = (1 << n) - 1
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2**n a part at most
    games = cells.select("part", F.expr("aggregate(cells, 0L, (a, c) -> a + c.n)").alias("total"), _game("n", full).alias("removal"), _game("good", full).alias("good"), _game("toxic", full).alias("toxic"))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(filters)])
    steps = games.withColumn("potential", _potential(n, full)).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    before = F.expr(f"aggregate(sequence(0, {n - 1}), 0, (m, i) -> m + if(instr(filter_order, substr('{filters}', i + 1, 1)) < step, shiftleft(1, i), 0))")
    own = F.expr(f"shiftleft(1, instr('{filters}', substr(filter_order, step, 1)) - 1)")
    here = lambda game: F.expr(f"{game}[before + own] - {game}[before]")
    return steps.withColumns({"before": before, "own": own}).select(
        "part",
        "filter_order",
        "step",
        F.expr("total - removal[before + own]").alias("kept"),
        here("removal").alias("removed"),
        (F.expr("removal[own]") - here("removal")).alias("redundant"),
        F.expr(f"removal[{full}] - removal[{full} - own]").alias("unique_fails"),
        here("good").alias("good_lost"),
        here("toxic").alias("toxic_lost"),
        F.expr(f"potential[{full}] - potential[{full} - own]").alias("shapley"),
    )
