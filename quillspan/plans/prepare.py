"""Queries of declarative aggregation, over line items as text cells with planted blanks and faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import prepare as p
from quillspan.plans.registry import query, rows

RAW = """SELECT l_returnflag AS flag, l_linestatus AS status, CASE WHEN l_orderkey % 29 = 0 THEN '' ELSE substring(CAST(l_shipdate AS STRING), 1, 7) END AS month,
  CASE WHEN l_orderkey % 11 = 0 THEN '' WHEN l_orderkey % 13 = 0 THEN 'NA' WHEN l_orderkey % 17 = 0 THEN '1,234' WHEN l_orderkey % 19 = 0 THEN 'abc' WHEN l_orderkey % 23 = 0 THEN 'NaN' WHEN l_orderkey % 31 = 0 THEN '1d' WHEN l_orderkey % 37 = 0 THEN 'n/a' WHEN l_orderkey % 41 = 0 THEN '0.1234567' WHEN l_orderkey % 43 = 0 THEN '-1e20' WHEN l_orderkey % 47 = 0 THEN '2.5E-7' WHEN l_orderkey % 53 = 0 THEN '1e999'
       ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END AS amount, l_orderkey, l_linenumber FROM {lineitem}"""
PARSED = f"""WITH raw AS ({RAW}), v AS (SELECT *, lower(trim(amount)) IN ('', 'na', 'null') AS blank,
  CASE WHEN regexp_matches(replace(trim(amount), ',', ''), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(replace(trim(amount), ',', '') AS DECIMAL(38,8)) END AS num FROM raw)
"""
GROUPED = PARSED + """, g AS (SELECT month AS period, flag, status, count(*) AS rows, count(num) AS n, sum(num) AS total, min(num) AS low, max(num) AS high, count(*) FILTER (NOT blank AND num IS NULL) AS invalid FROM v WHERE month <> '' GROUP BY ALL)
"""
#: The total in units of 1e-8 and, times 1e7, over n; a text is parsed to the nearest double.
SUM = "CAST(CAST(total AS VARCHAR) AS DOUBLE)"
MEAN = "CASE WHEN n > 0 THEN round(CAST(CAST((CAST(total * 100000000 AS HUGEINT) * 10000000) // n AS VARCHAR) || 'e-15' AS DOUBLE) * 1e9) / 1e9 END"
SPEC = p.Spec((p.Metric("rows", "count"), p.Metric("known", "count", "amount"), p.Metric("sum", "sum", "amount"), p.Metric("mean", "mean", "amount"), p.Metric("low", "min", "amount"), p.Metric("high", "max", "amount")), ("flag", "status"), "month")
RESULTS = """SELECT 'rows' AS metric_id, period, flag, status, CAST(rows AS DOUBLE) AS value, rows, n, invalid FROM g UNION ALL SELECT 'known', period, flag, status, CAST(n AS DOUBLE), rows, n, invalid FROM g
UNION ALL SELECT 'sum', period, flag, status, SUM, rows, n, invalid FROM g UNION ALL SELECT 'mean', period, flag, status, MEAN, rows, n, invalid FROM g
UNION ALL SELECT 'low', period, flag, status, CAST(low AS DOUBLE), rows, n, invalid FROM g UNION ALL SELECT 'high', period, flag, status, CAST(high AS DOUBLE), rows, n, invalid FROM g""".replace("SUM", SUM).replace("MEAN", MEAN)


@query("parse_metric_value", PARSED + "SELECT l_orderkey, l_linenumber, amount, CAST(num AS DOUBLE) AS parsed, CASE WHEN blank THEN 'SKIPPED' WHEN num IS NULL THEN 'INVALID' ELSE 'OK' END AS status FROM v")
def parse_metric_value(spark, sf_dir):
    return p.parse_values(rows(spark, sf_dir, RAW), "amount").select("l_orderkey", "l_linenumber", "amount", "parsed", "status")


@query("prepare_metrics", GROUPED + RESULTS)
def prepare_metrics(spark, sf_dir):
    return p.prepare_metrics(rows(spark, sf_dir, RAW), SPEC)


@query("exact_sum_mean", GROUPED + f"SELECT period, flag, status, {SUM} AS sum, {MEAN} AS mean, n FROM g")
def exact_sum_mean(spark, sf_dir):
    found = p.prepare_metrics(rows(spark, sf_dir, RAW), SPEC).filter("metric_id in ('sum', 'mean')")
    return found.groupBy("period", "flag", "status", "n").pivot("metric_id", ["sum", "mean"]).agg(F.first("value"))


@query("merge_partials", GROUPED + "SELECT period, flag, status, 'amount' AS \"column\", rows, n, coalesce(rtrim(rtrim(CAST(total AS VARCHAR), '0'), '.'), '0') AS total, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, invalid FROM g")
def merge_partials(spark, sf_dir):
    spec = p.Spec((p.Metric("sum", "sum", "amount"),), ("flag", "status"), "month")
    raw = rows(spark, sf_dir, RAW)
    loads = [p.partials(raw.filter(F.col("l_orderkey") % 3 == k), spec) for k in range(3)]
    merged = p.merge_partials(loads[2].unionByName(loads[0]).unionByName(loads[1]), spec.dimensions)
    return merged.select("period", "flag", "status", "column", "rows", "n", p.exact_text("total").alias("total"), "low", "high", "invalid")


@query("group_limit_guard", "SELECT count(*) AS groups, 100000 AS \"limit\", count(*) > 100000 AS exceeded FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM {orders})")
def group_limit_guard(spark, sf_dir):
    return p.group_limit(rows(spark, sf_dir, "SELECT o_custkey, o_orderpriority FROM {orders}"), ["o_custkey", "o_orderpriority"])


@query("prepared_results", GROUPED + f", r AS ({RESULTS}) SELECT *, value IS NULL AS missing, concat_ws(',', CASE WHEN n = 0 THEN 'NO_VALID_VALUES' END, CASE WHEN invalid > 0 THEN 'UNPARSEABLE_VALUES' END) AS flags FROM r")
def prepared_results(spark, sf_dir):
    return p.flag_results(p.prepare_metrics(rows(spark, sf_dir, RAW), SPEC))


SHAPES = "SELECT source AS project, CASE WHEN doc_id % 3 = 0 THEN 'raw' ELSE 'inline' END AS kind, n_chars AS bytes, doc_id % 2 = 0 AS prepared FROM {documents}"


@query("input_shape", f"SELECT project, count(*) FILTER (kind = 'inline') AS inline_documents, coalesce(sum(bytes) FILTER (kind = 'inline'), 0)::BIGINT AS inline_bytes, count(*) FILTER (kind = 'raw') AS raw_references, coalesce(sum(bytes) FILTER (kind = 'raw'), 0)::BIGINT AS raw_bytes, count(*) FILTER (kind = 'raw' AND NOT prepared) AS awaiting FROM ({SHAPES}) GROUP BY 1")
def input_shape(spark, sf_dir):
    return p.input_shape(rows(spark, sf_dir, SHAPES))
