"""Queries of run comparison and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import research as r
from quillspan.operators import runs as u
from quillspan.plans import research as plans
from quillspan.plans.registry import query, rows

DOCS = "SELECT source AS run, lang AS source, text, CAST(n_chars AS STRING) AS metadata FROM {documents}"
PRINTS = f"WITH h AS (SELECT run, sha256(concat_ws(chr(31), coalesce(source, ''), sha256(coalesce(text, '')), coalesce(metadata, ''))) AS h FROM ({DOCS})), p AS (SELECT run, count(*) AS n, " + ", ".join(f"CAST(sum(CAST('0x' || substring(h, {1 + 15 * k}, 15) AS HUGEINT)) AS VARCHAR) AS s{k}" for k in range(4)) + " FROM h GROUP BY 1), fp AS (SELECT run, n AS documents, sha256(concat_ws(',', CAST(n AS VARCHAR), s0, s1, s2, s3)) AS fingerprint FROM p)\n"


@query("input_fingerprint", PRINTS + "SELECT * FROM fp")
def input_fingerprint(spark, sf_dir):
    return u.input_fingerprint(rows(spark, sf_dir, DOCS))


AXES = "SELECT o_orderkey AS id, o_orderstatus AS a_input, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'O' END AS b_input, o_orderpriority AS a_execution, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '5-LOW' END AS b_execution FROM {orders}"


@query("axis_attribution", f"SELECT id, i AS input_axis, e AS execution_axis, CASE WHEN i = 'UNKNOWN' OR e = 'UNKNOWN' THEN 'UNKNOWN' WHEN i = 'SAME' AND e = 'SAME' THEN 'REPEAT' WHEN e = 'SAME' THEN 'INPUT' WHEN i = 'SAME' THEN 'EXECUTION' ELSE 'BOTH' END AS attribution FROM (SELECT id, CASE WHEN a_input IS NULL OR b_input IS NULL THEN 'UNKNOWN' WHEN a_input = b_input THEN 'SAME' ELSE 'CHANGED' END AS i, CASE WHEN a_execution IS NULL OR b_execution IS NULL THEN 'UNKNOWN' WHEN a_execution = b_execution THEN 'SAME' ELSE 'CHANGED' END AS e FROM ({AXES}))")
def axis_attribution(spark, sf_dir):
    return u.axis_attribution(rows(spark, sf_dir, AXES))


LEFT, RIGHT = ("SELECT sha2(text, 256) AS content FROM {documents} WHERE doc_id % 3 < 2", "SELECT sha2(text, 256) AS content FROM {documents} WHERE doc_id % 3 > 0")
LEFT_DUCK, RIGHT_DUCK = (t.replace("sha2(text, 256)", "sha256(text)") for t in (LEFT, RIGHT))


@query("document_set_diff", f"SELECT content, 'ADDED' AS change FROM (({RIGHT_DUCK}) EXCEPT ({LEFT_DUCK})) UNION ALL SELECT content, 'REMOVED' FROM (({LEFT_DUCK}) EXCEPT ({RIGHT_DUCK}))")
def document_set_diff(spark, sf_dir):
    return u.set_diff(rows(spark, sf_dir, LEFT), rows(spark, sf_dir, RIGHT), "content")


NESTED = """CASE WHEN o_orderkey % 2 = 0 THEN concat('"llm":', chr(123), '"host":"h', CAST(o_custkey % 2 AS STRING), '","parameters":', chr(123), '"top":', CAST(o_orderkey % 5 AS STRING), ',"stop":["a","', o_orderpriority, '"]', chr(125), chr(125))
  ELSE concat('"llm":', chr(123), '"parameters":', chr(123), '"stop":["a","', o_orderpriority, '"],"top":', CAST(o_orderkey % 5 AS STRING), chr(125), ',"host":"h', CAST(o_custkey % 2 AS STRING), '"', chr(125)) END"""
CONFIGS = f"""SELECT o_custkey % 50 AS run, o_orderkey AS seq, concat(chr(123), '"model":"m', CAST(o_orderkey % 3 AS STRING), '",', {NESTED}, ',"rules":"', o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN '","extra":"x"' ELSE '"' END, chr(125)) AS config FROM {{orders}}"""
KEYS = "(VALUES ('model'), ('rules'), ('extra'), ('llm.host'), ('llm.parameters.top'), ('llm.parameters.stop')) k(field)"
FIELDS = f"WITH c AS ({CONFIGS}), w AS (SELECT run, seq, config AS b, lag(config) OVER (PARTITION BY run ORDER BY seq) AS a FROM c), f AS (SELECT w.run, w.seq, k.field, coalesce(json_extract_string(a, '$.' || k.field), '') AS a_value, coalesce(json_extract_string(b, '$.' || k.field), '') AS b_value FROM w, {KEYS} WHERE a IS NOT NULL), changes AS (SELECT * FROM f WHERE a_value <> b_value)\n"


@query("instrument_changes", FIELDS + "SELECT * FROM changes")
def instrument_changes(spark, sf_dir):
    return u.instrument_changes(rows(spark, sf_dir, CONFIGS))


PAIRED = f"SELECT x.seq AS id, x.config AS a, y.config AS b FROM ({CONFIGS}) x JOIN ({CONFIGS}) y ON y.seq = x.seq + 1"


@query("config_field_diff", f"WITH w AS ({PAIRED}), f AS (SELECT id, k.field, coalesce(json_extract_string(a, '$.' || k.field), '') AS a_value, coalesce(json_extract_string(b, '$.' || k.field), '') AS b_value FROM w, {KEYS}) SELECT * FROM f WHERE a_value <> b_value")
def config_field_diff(spark, sf_dir):
    return u.config_field_diff(rows(spark, sf_dir, PAIRED))


METRICS = "SELECT concat(o_orderpriority, '/', CAST(o_custkey % 9 AS STRING)) AS metric, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM {orders} WHERE year(o_orderdate) = 1996 AND o_custkey % 4 > 0 GROUP BY 1"


@query("metric_deltas", f"SELECT metric, a.value AS a_value, b.value AS b_value, round(b.value - a.value, 6) AS delta FROM ({METRICS}) a FULL JOIN ({METRICS.replace('1996', '1997').replace('% 9', '% 11')}) b USING (metric)")
def metric_deltas(spark, sf_dir):
    return u.metric_deltas(rows(spark, sf_dir, METRICS), rows(spark, sf_dir, METRICS.replace("1996", "1997").replace("% 9", "% 11")))


REPEATS = "SELECT o_orderkey AS run, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_custkey % 200 AS STRING) END AS input, o_orderpriority AS execution, o_orderstatus AS metric, o_totalprice AS value FROM {orders}"


@query("repeat_groups", f"SELECT input, execution, metric, count(DISTINCT run) AS runs, min(value) AS low, max(value) AS high, count(DISTINCT run) >= 2 AS variation_known FROM ({REPEATS}) WHERE input IS NOT NULL GROUP BY 1, 2, 3")
def repeat_groups(spark, sf_dir):
    return u.repeat_groups(rows(spark, sf_dir, REPEATS))


SPANS = "SELECT CAST(o_custkey AS BIGINT) AS finding, CAST(floor(o_orderkey / 32) AS BIGINT) AS doc_id, CAST(o_orderkey % 32 * 10 AS BIGINT) AS start, CAST(o_orderkey % 32 * 10 + 5 + o_custkey % 40 AS BIGINT) AS end FROM {orders}"
SPANS_B = "SELECT CAST(l_suppkey AS BIGINT) AS finding, CAST(floor(l_orderkey / 32) AS BIGINT) AS doc_id, CAST(l_orderkey % 32 * 10 + l_linenumber AS BIGINT) AS start, CAST(l_orderkey % 32 * 10 + 5 + l_partkey % 40 AS BIGINT) AS end FROM {lineitem}"
MERGED = f"""WITH a AS ({SPANS}), b AS ({SPANS_B}), ua AS (SELECT DISTINCT finding, doc_id, unnest(generate_series(start, "end" - 1)) AS c FROM a), ub AS (SELECT DISTINCT finding, doc_id, unnest(generate_series(start, "end" - 1)) AS c FROM b),
na AS (SELECT finding, count(*) AS n FROM ua GROUP BY 1), nb AS (SELECT finding, count(*) AS n FROM ub GROUP BY 1), co AS (SELECT ua.finding AS a, ub.finding AS b, count(*) AS common FROM ua JOIN ub USING (doc_id, c) GROUP BY 1, 2),
ov AS (SELECT co.a, co.b, round(common / (na.n + nb.n - common), 3) AS overlap FROM co JOIN na ON na.finding = co.a JOIN nb ON nb.finding = co.b)
""".replace("AS end FROM", 'AS "end" FROM')
SPARK_SPANS, SPARK_SPANS_B = (t.replace("AS end FROM", "AS `end` FROM") for t in (SPANS, SPANS_B))


@query("span_overlap", MERGED + "SELECT * FROM ov")
def span_overlap(spark, sf_dir):
    return u.span_overlap(rows(spark, sf_dir, SPARK_SPANS), rows(spark, sf_dir, SPARK_SPANS_B))


@query("match_findings")
def match_findings(spark, sf_dir):
    a = rows(spark, sf_dir, "SELECT CAST(c_custkey AS BIGINT) AS finding, concat('t', CAST(c_custkey % 500 AS STRING)) AS title, c_mktsegment AS status FROM {customer}")
    b = rows(spark, sf_dir, "SELECT CAST(s_suppkey AS BIGINT) AS finding, concat('t', CAST(s_suppkey % 500 AS STRING)) AS title, CASE WHEN s_acctbal > 0 THEN 'BUILDING' END AS status FROM {supplier}")
    found = u.match_findings(rows(spark, sf_dir, SPARK_SPANS), rows(spark, sf_dir, SPARK_SPANS_B), a.select("finding", "title"), b.select("finding", "title"))
    return u.finding_changes(found, a, b, ["title", "status"])


RUNS = "SELECT o_custkey AS project, o_orderkey AS run, CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'FAILED' END AS status, o_totalprice AS metric, o_orderdate AS created_at, o_orderdate + INTERVAL '1' DAY AS finished_at FROM {orders}"


@query("metrics_history", f"SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY created_at, run) AS INT) AS pos, run, CASE WHEN status = 'COMPLETED' THEN metric END AS metric FROM ({RUNS})")
def metrics_history(spark, sf_dir):
    return u.metrics_history(rows(spark, sf_dir, RUNS))


@query("latest_completed_run", f"SELECT project, run FROM ({RUNS}) WHERE status = 'COMPLETED' QUALIFY row_number() OVER (PARTITION BY project ORDER BY finished_at DESC, created_at DESC, run DESC) = 1")
def latest_completed_run(spark, sf_dir):
    return u.latest_completed_run(rows(spark, sf_dir, RUNS))


SEQS = "SELECT DISTINCT o_custkey % 40 AS run, CAST(year(o_orderdate) - 1994 AS INT) AS seq, concat(CAST(o_custkey % 40 AS STRING), '/', CAST(year(o_orderdate) AS STRING)) AS analysis FROM {orders}"
DECLARED = "SELECT o_custkey % 40 AS run, CAST(year(o_orderdate) - 1994 AS INT) AS seq, concat(' ', o_orderpriority, ' ', CAST(o_orderkey % 25 AS STRING)) AS ref FROM {orders} WHERE o_orderstatus = 'F'"
GIVEN = DECLARED.replace("o_orderstatus = 'F'", "o_orderstatus <> 'F'").replace("' ', o_orderpriority", "o_orderpriority")
SNAPSHOT = "SELECT concat(CAST(o_custkey % 40 AS STRING), '/', CAST(year(o_orderdate) AS STRING)) AS analysis, concat(o_orderpriority, ' ', CAST(o_orderkey % 25 AS STRING)) AS ref, min(o_orderstatus) AS hash, min(CASE WHEN year(o_orderdate) > 1998 AND o_orderkey % 25 < 5 THEN 'v2' ELSE 'v1' END) AS definition FROM {orders} GROUP BY 1, 2"
EVENTS = f"""WITH it AS (SELECT *, lag(seq) OVER v AS prev, lag(analysis) OVER v AS prev_analysis FROM ({SEQS}) WINDOW v AS (PARTITION BY run ORDER BY seq)), de AS (SELECT DISTINCT run, seq, trim(ref) AS ref FROM ({DECLARED})), ad AS (SELECT DISTINCT run, seq, trim(ref) AS ref FROM ({GIVEN})), sn AS ({SNAPSHOT}),
gone AS (SELECT it.run, it.seq, p.ref FROM it JOIN de p ON p.run = it.run AND p.seq = it.prev WHERE EXISTS (SELECT 1 FROM de c WHERE c.run = it.run AND c.seq = it.seq) AND NOT EXISTS (SELECT 1 FROM de c WHERE c.run = it.run AND c.seq = it.seq AND c.ref = p.ref)),
here AS (SELECT * FROM de UNION SELECT * FROM ad), marks AS (SELECT *, seq * 2 AS spot, 0 AS kind FROM here UNION ALL SELECT *, seq * 2 + 1, 1 FROM gone),
past AS (SELECT *, max(spot) FILTER (kind = 0) OVER w AS mention, max(spot) FILTER (kind = 1) OVER w AS removal FROM marks WINDOW w AS (PARTITION BY run, ref ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ee AS (SELECT run, seq, ref, CASE WHEN kind = 1 THEN 'REMOVED' ELSE 'ADDED' END AS event FROM past WHERE kind = 1 OR mention IS NULL OR removal > mention
  UNION ALL SELECT it.run, it.seq, c.ref, CASE WHEN c.hash IS DISTINCT FROM p.hash THEN 'CONTENT_CHANGED' ELSE 'DEFINITION_CHANGED' END FROM it JOIN sn c ON c.analysis = it.analysis JOIN sn p ON p.analysis = it.prev_analysis AND p.ref = c.ref WHERE c.hash IS DISTINCT FROM p.hash OR c.definition IS DISTINCT FROM p.definition)
"""


@query("evidence_events", EVENTS + "SELECT * FROM ee WHERE event IS NOT NULL")
def evidence_events(spark, sf_dir):
    return u.evidence_events(*[rows(spark, sf_dir, text) for text in (SEQS, DECLARED, GIVEN, SNAPSHOT)])


ADDED = "SELECT o_custkey % 40 AS run, CAST(year(o_orderdate) - 1994 AS INT) AS seq FROM {orders} WHERE o_orderstatus = 'P'"
TOOLED = "SELECT o_custkey % 40 AS run, CAST(year(o_orderdate) - 1994 AS INT) AS seq FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'"


@query("change_attribution", "WITH x AS (SELECT 1)" + plans.EVOLVED[:-1] + f", e AS (SELECT DISTINCT * FROM ({ADDED})), i AS (SELECT DISTINCT * FROM ({TOOLED})) SELECT c.run, c.seq, key, change, CASE WHEN e.run IS NOT NULL AND i.run IS NOT NULL THEN 'BOTH' WHEN e.run IS NOT NULL THEN 'EVIDENCE' WHEN i.run IS NOT NULL THEN 'INSTRUMENT' ELSE 'NONE' END AS attribution, change IN ('WEAKENED', 'CONTRADICTED') AS invalidates FROM changed c LEFT JOIN e ON e.run = c.run AND e.seq = c.seq LEFT JOIN i ON i.run = c.run AND i.seq = c.seq")
def change_attribution(spark, sf_dir):
    return u.change_attribution(r.hypothesis_evolution(rows(spark, sf_dir, plans.STATES)), rows(spark, sf_dir, ADDED), rows(spark, sf_dir, TOOLED))


UNSURE = "SELECT o_custkey % 40 AS run, CAST(year(o_orderdate) - 1994 AS INT) AS seq, concat('s', CAST(o_orderkey % 30 AS STRING)) AS statement FROM {orders}"


@query("uncertainty_carry", f"WITH s AS (SELECT DISTINCT * FROM ({UNSURE})), k AS (SELECT DISTINCT run, seq FROM s) SELECT b.run, k.seq, b.statement, CASE WHEN n.run IS NOT NULL THEN 'CARRIED' ELSE 'RESOLVED' END AS state FROM s b JOIN k ON k.run = b.run AND k.seq = b.seq + 1 LEFT JOIN s n ON n.run = k.run AND n.seq = k.seq AND n.statement = b.statement")
def uncertainty_carry(spark, sf_dir):
    return u.uncertainty_carry(rows(spark, sf_dir, UNSURE))


MADE = "SELECT o_custkey AS iteration, CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 5 = 1 THEN o_orderstatus ELSE 'r1' END AS run FROM {orders}"


@query("iteration_run", f"SELECT iteration, CASE WHEN count(DISTINCT run) = 1 THEN min(run) END AS run, CASE WHEN count(DISTINCT run) > 1 THEN 'MIXED_RUNS' END AS error FROM ({MADE}) GROUP BY 1")
def iteration_run(spark, sf_dir):
    return u.iteration_run(rows(spark, sf_dir, MADE))


GATES = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS before, CASE WHEN o_orderkey % 4 = 0 THEN 'O' ELSE o_orderstatus END AS after FROM {orders}"


@query("reevaluation_gate", f"SELECT id, NOT coalesce(before = after, false) AS proceed, CASE WHEN before = after THEN 'NO_EVIDENCE_CHANGE' END AS reason FROM ({GATES})")
def reevaluation_gate(spark, sf_dir):
    return u.reevaluation_gate(rows(spark, sf_dir, GATES))


HYPS = "SELECT o_custkey AS run, CAST(o_orderdate AS DATE) AS at, o_orderpriority AS what FROM {orders}"
EVALS = "SELECT c_custkey AS run, DATE '1998-01-01' AS at, c_mktsegment AS what FROM {customer}"


@query("timeline_scenario_events", f"WITH t AS (SELECT run, \"at\", 'HYPOTHESIS' AS kind, what FROM ({HYPS.replace('AS at', 'AS \"at\"')}) UNION ALL SELECT run, \"at\", 'SCENARIO', what FROM ({EVALS.replace('AS at', 'AS \"at\"')})) SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY \"at\", kind, what) AS INT) AS pos, \"at\", kind, what FROM t")
def timeline_scenario_events(spark, sf_dir):
    return u.timeline_events(rows(spark, sf_dir, HYPS), rows(spark, sf_dir, EVALS))
