"""Queries of profiling and triage, over orders as a text table with planted blanks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import profile as p
from quillspan.plans.registry import query, rows

RAW = """SELECT concat('id-', CAST(o_orderkey AS STRING)) AS order_id, CASE WHEN o_orderkey % 3 = 0 THEN concat(' ', o_orderstatus, chr(9)) ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'NA' WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS priority,
  CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS revenue, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS price, CASE WHEN o_orderkey % 5 = 0 THEN '99999999999999999999' ELSE CAST(o_custkey * 0.0001 AS STRING) END AS ratio, substring(CAST(o_orderdate AS STRING), 1, 10) AS ordered,
  CAST(year(o_orderdate) AS STRING) AS fiscal_year, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'False' END AS flag, CASE WHEN o_orderkey % 2 = 0 THEN 'n/a' ELSE '' END AS nothing FROM {orders}"""
NAMES = "order_id status priority revenue price ratio ordered fiscal_year flag nothing".split()
LONG = f"WITH raw AS ({RAW}), cells AS (" + " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS name, regexp_replace({c}, '^\\s+|\\s+$', '', 'g') AS cell FROM raw" for i, c in enumerate(NAMES)) + r""")
, k AS (SELECT *, lower(trim(cell)) NOT IN ('', 'na', 'null', 'n/a') AS known, regexp_full_match(trim(cell), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AS num, regexp_full_match(trim(cell), '[+-]?[0-9]+') AND TRY_CAST(cell AS BIGINT) IS NOT NULL AS whole,
  CASE WHEN regexp_full_match(cell, '\d{4}-\d{2}-\d{2}') THEN try_strptime(cell, '%Y-%m-%d') IS NOT NULL WHEN regexp_full_match(cell, '\d{4}-\d{2}') THEN try_strptime(cell, '%Y-%m') IS NOT NULL ELSE false END AS dated FROM cells)
, t AS (SELECT position, name, CASE WHEN count(*) FILTER (known) = 0 THEN 'EMPTY' WHEN bool_and(dated) FILTER (known) AND NOT bool_and(num) FILTER (known) THEN 'DATE' WHEN bool_and(whole) FILTER (known) THEN 'INTEGER' WHEN bool_and(num) FILTER (known) THEN 'NUMBER'
  WHEN bool_and(lower(trim(cell)) IN ('true', 'false')) FILTER (known) THEN 'BOOLEAN' ELSE 'STRING' END AS type, count(*) FILTER (known) AS non_null, count(*) FILTER (NOT known) AS nulls, count(DISTINCT cell) FILTER (known) AS d,
  min(TRY_CAST(trim(cell) AS DOUBLE)) FILTER (known AND num) AS ln, max(TRY_CAST(trim(cell) AS DOUBLE)) FILTER (known AND num) AS hn, min(cell) FILTER (known) AS ls, max(cell) FILTER (known) AS hs FROM k GROUP BY 1, 2)
"""
PROFILE = LONG + """, s AS (SELECT position, string_agg(substring(cell, 1, 64), '|' ORDER BY cell) AS samples FROM (SELECT DISTINCT position, cell, dense_rank() OVER (PARTITION BY position ORDER BY cell) AS r FROM k WHERE known) WHERE r <= 5 GROUP BY 1)
, prof AS (SELECT position, name, type, non_null, nulls, least(d, 10000) AS distinct_values, d > 10000 AS capped, CASE WHEN type IN ('INTEGER', 'NUMBER') THEN CASE WHEN ln = 99999999999999999999 THEN '100000000000000000000' ELSE regexp_replace(CAST(ln AS VARCHAR), '[.]0$', '') END WHEN type IN ('DATE', 'STRING') THEN substring(ls, 1, 64) END AS low,
  CASE WHEN type IN ('INTEGER', 'NUMBER') THEN CASE WHEN hn = 99999999999999999999 THEN '100000000000000000000' ELSE regexp_replace(CAST(hn AS VARCHAR), '[.]0$', '') END WHEN type IN ('DATE', 'STRING') THEN substring(hs, 1, 64) END AS high, coalesce(samples, '') AS samples FROM t LEFT JOIN s USING (position))
"""
GAPS = "SELECT concat('g', CAST(r_regionkey AS STRING)) AS gap_id, CASE r_regionkey WHEN 0 THEN 'Prices by region' WHEN 1 THEN 'status history' WHEN 2 THEN 'orders overdue' ELSE r_name END AS need FROM {region}"
QUESTION = "How did revenue change?"


@query("profile_table", PROFILE + "SELECT * FROM prof")
def profile_table(spark, sf_dir):
    return p.profile_table(rows(spark, sf_dir, RAW))


@query("infer_column_type", LONG + "SELECT position, name, type FROM t")
def infer_column_type(spark, sf_dir):
    return p.infer_types(rows(spark, sf_dir, RAW))


@query("profile_fingerprint", PROFILE + r"SELECT sha256(string_agg(line, E'\n' ORDER BY line)) AS fingerprint FROM (SELECT concat_ws(chr(31), lpad(CAST(position AS VARCHAR), 6, '0'), name, type, CAST(non_null AS VARCHAR), CAST(nulls AS VARCHAR), CAST(distinct_values AS VARCHAR), coalesce(low, ''), coalesce(high, ''), samples) AS line FROM prof)")
def profile_fingerprint(spark, sf_dir):
    return p.profile_fingerprint(p.profile_table(rows(spark, sf_dir, RAW)))


LINKED = f""", gaps AS ({GAPS}), ct AS (SELECT DISTINCT name, unnest(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+')) AS t FROM t), gt AS (SELECT DISTINCT gap_id, unnest(regexp_extract_all(lower(need), '[\\p{{L}}\\p{{N}}]+')) AS g FROM gaps),
links AS (SELECT DISTINCT name, gap_id FROM ct, gt WHERE length(t) >= 2 AND length(g) >= 2 AND (t = g OR (length(t) >= 4 AND length(g) >= 4 AND (starts_with(t, g) OR starts_with(g, t)))))
""".replace("{{", "{").replace("}}", "}")


@query("link_gap_tokens", (LONG + LINKED + "SELECT name, gap_id FROM links").replace("{L}", "L").replace("{N}", "N"))
def link_gap_tokens(spark, sf_dir):
    return p.link_gap_tokens(p.infer_types(rows(spark, sf_dir, RAW)), rows(spark, sf_dir, GAPS))


@query("triage_columns", (PROFILE + LINKED + """, l AS (SELECT name, string_agg(gap_id, ',' ORDER BY gap_id) AS gaps FROM links GROUP BY 1),
r AS (SELECT p.*, l.gaps, (SELECT count(*) FROM raw) AS total, EXISTS (SELECT 1 FROM ct WHERE ct.name = p.name AND length(t) >= 2 AND (contains('how', t) OR contains('did', t) OR contains('revenue', t) OR contains('change', t))) AS asked,
  EXISTS (SELECT 1 FROM ct WHERE ct.name = p.name AND t IN ('year', 'month', 'date', 'period', 'fy', 'quarter', 'week', 'day')) AS named FROM prof p LEFT JOIN l USING (name)),
b AS (SELECT *, CASE WHEN type = 'EMPTY' THEN 'NEEDS_REVIEW' WHEN type = 'DATE' OR (type = 'INTEGER' AND named) THEN 'INCLUDE' WHEN type IN ('INTEGER', 'NUMBER') THEN CASE WHEN asked OR gaps IS NOT NULL THEN 'INCLUDE' ELSE 'DEFER' END
  WHEN type = 'STRING' AND total > 50 AND distinct_values >= total THEN 'DEFER' WHEN distinct_values <= 50 AND NOT capped THEN 'INCLUDE' ELSE 'NEEDS_REVIEW' END AS base,
  CASE WHEN type = 'EMPTY' THEN NULL WHEN type = 'DATE' OR (type = 'INTEGER' AND named) THEN 'PERIOD' WHEN type IN ('INTEGER', 'NUMBER') THEN 'METRIC' WHEN type = 'STRING' AND total > 50 AND distinct_values >= total THEN 'IDENTIFIER' WHEN distinct_values <= 50 AND NOT capped THEN 'DIMENSION' END AS role FROM r)
SELECT name, CASE WHEN gaps IS NOT NULL AND type <> 'EMPTY' THEN 'INCLUDE' ELSE base END AS bucket, role, coalesce(gaps, '') AS gaps FROM b""").replace("{L}", "L").replace("{N}", "N"))
def triage_columns(spark, sf_dir):
    raw = rows(spark, sf_dir, RAW)
    return p.triage_columns(p.profile_table(raw), QUESTION, rows(spark, sf_dir, GAPS), raw.count())


COLUMNS = "SELECT n_nationkey AS position, n_name AS name FROM {nation}"
DECISIONS = """SELECT n_nationkey AS ord, n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'INCLUDE' WHEN 1 THEN 'EXCLUDE' ELSE 'DEFER' END AS bucket, n_nationkey % 3 = 0 AS by_human FROM {nation} WHERE n_nationkey % 5 <> 4
UNION ALL SELECT 100 + n_nationkey, n_name, 'NEEDS_REVIEW', true FROM {nation} WHERE n_nationkey % 2 = 0 UNION ALL SELECT 200 + r_regionkey, r_name, 'INCLUDE', false FROM {region}"""
PLAN = f"WITH c AS ({COLUMNS}), d AS ({DECISIONS}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) AS r FROM d) WHERE r = 1), plan AS (SELECT c.position, c.name, CASE WHEN f.bucket IS NULL THEN 'NEEDS_REVIEW' WHEN f.bucket = 'EXCLUDE' AND NOT f.by_human THEN 'DEFER' ELSE f.bucket END AS bucket FROM c LEFT JOIN f USING (name))\n"
MOVES = "SELECT s_suppkey AS ord, n_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'INCLUDE' WHEN 1 THEN 'DEFER' ELSE 'EXCLUDE' END AS to_bucket FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE n_nationkey % 3 <> 1"
REVISED = PLAN[:-1] + f", m AS ({MOVES}), st AS (SELECT name, arg_max(to_bucket, ord) AS to_bucket, arg_max(coalesce(came, ''), ord) AS came FROM (SELECT *, lag(to_bucket) OVER (PARTITION BY name ORDER BY ord) AS came FROM m) GROUP BY 1), revised AS (SELECT p.name, CASE WHEN st.name IS NOT NULL THEN coalesce(nullif(st.came, ''), p.bucket) END AS from_bucket, coalesce(st.to_bucket, p.bucket) AS bucket, p.bucket AS old FROM plan p LEFT JOIN st USING (name))\n"


@query("normalize_plan", PLAN + "SELECT * FROM plan")
def normalize_plan(spark, sf_dir):
    return p.normalize_plan(rows(spark, sf_dir, COLUMNS), rows(spark, sf_dir, DECISIONS))[0]


@query("normalize_plan_errors", f"SELECT d.ord, d.name FROM ({DECISIONS}) d ANTI JOIN ({COLUMNS}) c USING (name)")
def normalize_plan_errors(spark, sf_dir):
    return p.normalize_plan(rows(spark, sf_dir, COLUMNS), rows(spark, sf_dir, DECISIONS))[1]


@query("revise_plan", REVISED + "SELECT name, from_bucket, bucket FROM revised")
def revise_plan(spark, sf_dir):
    return p.revise_plan(normalize_plan(spark, sf_dir), rows(spark, sf_dir, MOVES))


@query("diff_plan", REVISED + "SELECT name, old AS old_bucket, bucket AS new_bucket FROM revised WHERE old IS DISTINCT FROM bucket")
def diff_plan(spark, sf_dir):
    plan = normalize_plan(spark, sf_dir)
    return p.diff_plan(plan, p.revise_plan(plan, rows(spark, sf_dir, MOVES)))


REFS = "SELECT p_partkey AS ord, p_brand AS gap_id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '  ' END AS need, p_type AS dimension FROM {part}"


@query("merge_gap_refs", f"SELECT gap_id, coalesce(arg_min(need, ord) FILTER (trim(need) <> ''), '') AS need, string_agg(DISTINCT dimension, ',' ORDER BY dimension) AS dimensions FROM ({REFS}) GROUP BY 1")
def merge_gap_refs(spark, sf_dir):
    return p.merge_gap_refs(rows(spark, sf_dir, REFS))
