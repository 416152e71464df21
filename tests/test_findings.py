"""Cases of review findings: each failed before its fix."""

import time

import duckdb
from pyspark.sql import functions as F

from quillspan.functions.values import upper_each
from quillspan.operators import research, runs, text
from quillspan.plans.registry import queries

GAPS = "run long, gap_id long, need string, category string, resolvable boolean, resolved boolean, hypothesis string"


def test_dependencies_of_long_ids_and_several_hypotheses(spark):
    """Ids are cut to eight characters only where they are shown; a gap that waits for itself loses itself and no other."""
    rows = [(1, 123456789, "n", "COMPARISON", True, False, "h"), (1, 123456789, "n", "MEASUREMENT", True, False, "h"), (1, 123456780, "n", "MEASUREMENT", True, False, "h"), (1, 7, "n", "CONFOUNDER", True, False, "h"), (1, 7, "n", "CONFOUNDER", True, False, "g"), (1, 8, "n", "SOURCE_QUALITY", True, False, "g"), (1, 8, "n", "SOURCE_QUALITY", True, False, "h"), (1, 9, "n", "SOURCE_QUALITY", True, True, "g"), (1, None, "n", "SOURCE_QUALITY", True, False, "g"), (2, 10, "n", "PRE_PERIOD", True, False, "h")]
    gaps = spark.createDataFrame(rows, GAPS)
    assert {r.gap_id: r.depends_on for r in research.gap_dependencies(gaps).collect()} == {123456789: "00000008,12345678", 7: "00000008,12345678"}
    assert {r.gap_id: r.waits for r in research._waits(gaps).collect()} == {123456789: 2, 7: 3}


def test_dependencies_shuffle_no_lists_of_gaps(spark):
    """Nothing is exchanged or grouped after the lists meet their gaps."""
    gaps = spark.range(400).selectExpr("0L AS run", "id AS gap_id", "'n' AS need", "if(id % 2 = 0, 'COMPARISON', 'MEASUREMENT') AS category", "true AS resolvable", "false AS resolved", "'h' AS hypothesis")
    plan = research.gap_dependencies(gaps)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_cited_evidence_does_not_meet_all_evidence_of_its_hypothesis(spark):
    n = 40_000
    basis = spark.range(n).selectExpr("id AS claim_id", "'h' AS hypothesis", "'BASIS' AS role")
    cited = spark.range(n).selectExpr("id AS claim_id", "id AS doc_id", "cast(id AS string) AS observation_id")
    evidence = spark.range(n).selectExpr("'h' AS hypothesis", "id AS doc_id", "cast(id div 2 AS string) AS observation_id", "if(id % 2 = 0, 'support', 'counter') AS type")
    start = time.time()
    got = research.claim_evidence(basis, cited, evidence).agg(*[F.sum(k).alias(k) for k in ("support", "counter", "neutral")]).first()
    assert tuple(got) == (n - 1, n, 0)  # claim 0 cites document 0 both ways
    assert time.time() - start < 60  # 1.6 billion pairs before


def test_capitals_by_character(spark):
    chars = [(i, chr(i)) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000]
    table = spark.createDataFrame(chars, "i int, c string")
    got = {r.i: r.u for r in table.select("i", F.expr(upper_each("concat(c, 'ß')")).alias("u")).collect()}
    want = dict(duckdb.sql("SELECT i, upper(concat(chr(i::INT), 'ß')) FROM range(1, 131072) t(i) WHERE i NOT BETWEEN 55296 AND 57343").fetchall())
    assert [hex(i) for i in want if got[i] != want[i]] == []
    quotes = spark.createDataFrame([(1, 1, "STRAẞE"), (2, 1, "ΣΑΣ")], "quote_id long, doc_id long, quote string")
    docs = spark.createDataFrame([(1, "die Straße İ σασα")], "doc_id long, text string")
    assert {r.quote_id: (r.start_offset, r.end_offset) for r in text.ground_quotes(quotes, docs).collect()} == {1: (4, 10), 2: (13, 16)}


def test_observations_of_one_time(spark, tmp_path):
    """Every event has its row, whatever shares its time, in any order of arrival."""
    rows = [(e, 1_700_000_000 + (e * 7 % 40) // 4 * 50_000, "ab"[e % 2], float(e * 13 % 17)) for e in range(60)]
    frame = spark.createDataFrame(rows, "event_id long, s long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s"))
    frame.write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.series, r["at"], r.value, r.delta is None, r.delta or 0.0) for r in queries()["stream_observation_delta"](spark, str(tmp_path)).collect())
    want = duckdb.sql(f"SELECT event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), value, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) FROM '{tmp_path}/events.parquet/*.parquet'").fetchall()
    assert got == sorted((s, at, v, d is None, d or 0.0) for s, at, v, d in want) and len(got) == 60


def test_pairs_of_spans_are_shuffled_once(spark):
    spans = spark.createDataFrame([(1, 1, 0, 10), (2, 1, 5, 600), (3, 2, 0, 4)], "finding long, doc_id long, start long, end long")
    over = runs.span_overlap(spans, spans)
    assert {(r.a, r.b): r.overlap for r in over.collect()} == {(1, 1): 1.0, (2, 2): 1.0, (3, 3): 1.0, (1, 2): 0.008, (2, 1): 0.008}
    plan = over._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Aggregate")]


def test_long_lists_of_dependencies_come_in_tasks_of_their_own(spark):
    """A task that holds rows of a long list holds no other list, and what is joined carries the list once."""
    gaps = spark.range(600).selectExpr("id % 3 AS run", "id AS gap_id", "if(id % 2 = 0, 'COMPARISON', 'MEASUREMENT') AS category", "false AS resolved", "cast(id % 5 AS string) AS hypothesis")
    whole, apart = research.gap_dependencies(gaps), research.gap_dependencies(gaps, wide=100)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, apart.collect())) and whole.count() == 300
    tasks = apart.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("depends_on").alias("lists")).collect()
    assert {t.lists for t in tasks} == {1} and len(tasks) > 15
