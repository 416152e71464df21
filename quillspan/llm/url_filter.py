"""URL filters by a sort-merge range join, in DataFrame functions only.

A rule (host, path) covers the hosts that end in its host at a label and the paths that start with its path. Its key is
the host's labels reversed, then the path; the keys that it covers under one host form the interval from the key to the
key followed by a byte that no text holds. Intervals either nest or lie apart. A page is a point in the order of keys once
for each ending of its host. A sweep over the sorted keys opens and closes intervals: the depth is a running sum, and the
stack's top at a depth is the last rule opened at that depth.

Sweeps run in shards. Points are dealt to shards by a salt, so a host with a third of all pages is no bottleneck; rules are
copied to every salt of their own bucket of hosts, and the number of buckets grows with the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import shards

#: Copies of rules that sweeps may hold together; beyond it rules are split by host.
RULE_COPIES = 5_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: str = "url") -> list:
    """Columns host and path: empty for a null url and one without ``://``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return [F.translate(F.regexp_extract(text, SPLIT, 1), UPPER, LOWER).alias("host"), F.regexp_extract(text, SPLIT, 2).alias("path")]


def _key(host, path):
    return F.concat(host.cast("binary"), F.lit(b"\x01"), path.cast("binary"))


def url_verdicts(pages: DataFrame, rules: DataFrame, *, default: str = "allow", rule_copies: int = RULE_COPIES) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url; other columns are not read): page_id, host, path, rule, verdict.

    ``rules``: host, path, verdict (allow or block); of a repeated (host, path) block wins; rows with a null are left out.
    The longest rule (code points of host and path) wins, at one length the one with the longer host. Without a fitting
    rule, ``rule`` is null and the verdict ``default``. Repeated pages and null ids stay as they are; an empty table of
    rules gives every page the default.
    """
    spark = pages.sparkSession
    rules = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.split("host", r"\.", -1)
    rules = rules.withColumn("reversed", F.concat_ws(".", F.reverse(labels)))
    n, levels = rules.agg(F.count("*"), F.coalesce(F.max(F.size(labels)), F.lit(1))).first()
    parts = shards(spark)
    buckets = max(1, min(parts, -(-n * parts // rule_copies)))
    salts = max(1, parts // buckets)
    bucket = F.pmod(F.xxhash64("reversed"), F.lit(buckets)) * salts

    opened = F.struct(F.char_length(F.concat("host", "path")).alias("length"), F.char_length("host").alias("host_length"), F.concat("host", "path").alias("rule"), "verdict")
    placed = rules.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), bucket.alias("bucket"), _key(F.col("reversed"), F.col("path")).alias("key"), opened.alias("opened"))
    shard = (F.col("bucket") + F.col("salt")).alias("shard")
    page = F.struct("rid", "page_id", "host", "path").alias("page")
    points = (
        pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long").alias("page_id"), *url_parts())
        .withColumn("labels", F.reverse(labels))
        .withColumn("level", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(levels)))))
        .withColumn("reversed", F.concat_ws(".", F.slice("labels", F.lit(1), F.col("level"))))
        .select((bucket + F.pmod(F.xxhash64("rid"), F.lit(salts))).alias("shard"), _key(F.col("reversed"), F.col("path")).alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("step"), page, F.lit(None).cast(placed.schema["opened"].dataType).alias("opened"))
    )
    no_page = F.lit(None).cast(points.schema["page"].dataType).alias("page")
    opens = placed.select(shard, "key", F.lit(0).alias("kind"), F.lit(1).alias("step"), no_page, "opened")
    closes = placed.select(shard, F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), no_page, F.lit(None).cast(placed.schema["opened"].dataType).alias("opened"))
    order = [F.col("key"), F.col("kind")]
    so_far = (Window.unboundedPreceding, Window.currentRow)
    swept = (
        points.unionByName(opens)
        .unionByName(closes)
        .withColumn("depth", F.sum("step").over(Window.partitionBy("shard").orderBy(*order).rowsBetween(*so_far)))
        .withColumn("top", F.last("opened", ignorenulls=True).over(Window.partitionBy("shard", "depth").orderBy(*order).rowsBetween(*so_far)))
        .filter("kind = 1")
    )
    best = swept.groupBy("page").agg(F.max("top").alias("best"))
    return best.select("page.page_id", "page.host", "page.path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
