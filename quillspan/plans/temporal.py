"""Queries of the time-series operators, over the tables' own calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import temporal as t
from quillspan.plans.registry import query, rows

#: Monthly revenue per order priority; sums are exact decimals, so no order of rows changes them.
MONTHS = "SELECT o_orderpriority AS series, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS idx, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM {orders} GROUP BY 1, 2"
YEARS = "SELECT o_orderpriority AS series, CAST(year(o_orderdate) AS INT) AS idx, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM {orders} GROUP BY 1, 2"
#: Daily sums per event type; every seventh day is left out to make gaps.
DAYS = "SELECT event_type AS series, CAST(datediff(CAST(ts AS DATE), DATE '1970-01-01') AS INT) AS idx, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value FROM {events} WHERE day(ts) % 7 <> 3 GROUP BY 1, 2"
DAYS_DUCK = DAYS.replace("datediff(CAST(ts AS DATE), DATE '1970-01-01')", "date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))")
AMOUNTS = "SELECT l_returnflag AS series, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INT) AS idx, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM {lineitem} GROUP BY 1, 2"
QUANTITIES = AMOUNTS.replace("l_extendedprice", "l_quantity")
RETURNED = AMOUNTS.replace("SELECT l_returnflag", "SELECT 'all'").replace("{lineitem}", "{lineitem} WHERE l_returnflag = 'R'")
SHIPPED = AMOUNTS.replace("SELECT l_returnflag", "SELECT 'all'")

FILLED = """WITH p AS ({0}), spans AS (SELECT series, min(idx) AS low, max(idx) AS high FROM p GROUP BY 1),
f AS (SELECT s.series, CAST(g.idx AS INT) AS idx, p.value, p.series IS NULL AS is_gap FROM spans s, LATERAL (SELECT unnest(generate_series(s.low, s.high)) AS idx) g LEFT JOIN p ON p.series = s.series AND p.idx = g.idx)
"""


def filled(points: str, rest: str) -> str:
    return FILLED.replace("{0}", points) + rest


POP = """SELECT series, idx, round((value - before) / nullif(abs(before), 0), 9) AS value,
  CASE WHEN value IS NULL OR before IS NULL THEN 'MISSING_OR_GAP' WHEN before = 0 THEN 'ZERO_BASELINE' END AS flag
FROM (SELECT *, lag(value, LAG) OVER w AS before, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY series ORDER BY idx)) WHERE n > LAG"""


@query("calendar_index", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS label, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS month_idx, date_diff('day', DATE '1970-01-01', CAST(date_trunc('month', o_orderdate) AS DATE)) AS day_idx, strftime(o_orderdate, '%Y-%m') AS back FROM {orders}")
def calendar_index(spark, sf_dir):
    labels = rows(spark, sf_dir, "SELECT DISTINCT substring(CAST(o_orderdate AS STRING), 1, 7) AS label FROM {orders}")
    month = t.calendar_index(F.col("label"), "calendar-month")
    day = t.calendar_index(F.concat("label", F.lit("-01")), "calendar-day")
    return labels.select("label", month.cast("long").alias("month_idx"), day.cast("long").alias("day_idx"), t.calendar_label(month, "calendar-month").alias("back"))


RESULTS = """SELECT 'revenue' AS metric_id, o_orderpriority, o_orderstatus, substring(CAST(o_orderdate AS {0}), 1, 7) AS period, 'calendar-month' AS basis, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM {orders} GROUP BY 2, 3, 4"""


@query("extract_series", "SELECT 'priority=' || o_orderpriority || ',status=' || o_orderstatus AS series, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS idx, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM {orders} WHERE o_orderstatus = 'O' GROUP BY 1, 2")
def extract_series(spark, sf_dir):
    facts = rows(spark, sf_dir, RESULTS.replace("{0}", "STRING"))
    facts = facts.withColumn("dims", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority"))
    points, _ = t.extract_series(facts, "revenue", {"status": "O"})
    return points.withColumn("idx", F.col("idx").cast("long"))


@query("gap_fill", filled(DAYS_DUCK, "SELECT series, idx, round(value, 4) AS value, is_gap FROM f"))
def gap_fill(spark, sf_dir):
    return t.gap_fill(rows(spark, sf_dir, DAYS)).withColumn("value", F.round("value", 4))


@query("period_over_period", filled(DAYS_DUCK, POP.replace("LAG", "2")))
def period_over_period(spark, sf_dir):
    return t.period_over_period(rows(spark, sf_dir, DAYS), 2)


@query("yoy", filled(MONTHS, POP.replace("LAG", "12")))
def yoy(spark, sf_dir):
    return t.yoy(rows(spark, sf_dir, MONTHS), "calendar-month")


@query("mom", filled(MONTHS, POP.replace("LAG", "1")))
def mom(spark, sf_dir):
    return t.mom(rows(spark, sf_dir, MONTHS), "calendar-month")


@query("qoq", filled(MONTHS, POP.replace("LAG", "3")))
def qoq(spark, sf_dir):
    return t.qoq(rows(spark, sf_dir, MONTHS), "calendar-month")


@query("cagr", filled(YEARS, """SELECT series, CASE WHEN n >= 2 AND a > 0 AND b > 0 THEN round(pow(b / a, 1.0 / (hi - lo)) - 1, 9) END AS value,
  CASE WHEN n < 2 THEN 'INSUFFICIENT_POINTS' ELSE nullif(concat_ws(',', CASE WHEN hi - lo + 1 > n THEN 'INTERIOR_GAPS' END, CASE WHEN NOT (a > 0 AND b > 0) THEN 'NON_POSITIVE_ENDPOINT' END), '') END AS flag
FROM (SELECT series, arg_min(value, idx) AS a, arg_max(value, idx) AS b, min(idx) AS lo, max(idx) AS hi, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY 1)"""))
def cagr(spark, sf_dir):
    return t.cagr(rows(spark, sf_dir, YEARS), "calendar-year")


@query("rolling_mean", filled(DAYS_DUCK, """SELECT series, idx, CASE WHEN known = 3 THEN round(mean, 6) END AS value, CASE WHEN known < 3 THEN 'INCOMPLETE_WINDOW' END AS flag
FROM (SELECT series, idx, avg(value) OVER w AS mean, count(value) OVER w AS known, row_number() OVER (PARTITION BY series ORDER BY idx) AS n FROM f WINDOW w AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE n >= 3"""))
def rolling_mean(spark, sf_dir):
    return t.rolling_mean(rows(spark, sf_dir, DAYS), 3)


@query("rolling_delta", filled(DAYS_DUCK, """SELECT series, idx, round(d, 6) AS value, CASE WHEN d IS NULL THEN 'INCOMPLETE_WINDOW' END AS flag
FROM (SELECT series, idx, value - lag(value, 7) OVER w AS d, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY series ORDER BY idx)) WHERE n > 7"""))
def rolling_delta(spark, sf_dir):
    return t.rolling_delta(rows(spark, sf_dir, DAYS), 7)


@query("indexed_baseline", filled(DAYS_DUCK, """, g AS (SELECT *, max(CASE WHEN idx = 19723 THEN value END) OVER (PARTITION BY series) AS base FROM f)
SELECT series, idx, round(value / base * 100, 9) AS value, CASE WHEN value IS NULL THEN 'MISSING_OR_GAP' END AS flag FROM g WHERE base <> 0
UNION ALL SELECT DISTINCT series, CAST(NULL AS INT), CAST(NULL AS DOUBLE), CASE WHEN base IS NULL THEN 'MISSING_BASELINE' ELSE 'ZERO_BASELINE' END FROM g WHERE base IS NULL OR base = 0"""))
def indexed_baseline(spark, sf_dir):
    return t.indexed_baseline(rows(spark, sf_dir, DAYS), 19723)  # 2024-01-01


SHARE = """, q AS (WHOLE) SELECT f.series, f.idx, round(f.value / nullif(q.value, 0), 9) AS value,
  CASE WHEN f.value IS NULL OR q.value IS NULL THEN 'MISSING_OR_GAP' WHEN q.value = 0 THEN 'ZERO_DENOMINATOR' END AS flag UNIT FROM f LEFT JOIN q USING (series, idx)"""


@query("share", filled(RETURNED, SHARE.replace("WHOLE", SHIPPED).replace("UNIT", "")))
def share(spark, sf_dir):
    return t.share(rows(spark, sf_dir, RETURNED), rows(spark, sf_dir, SHIPPED))


@query("unit_price", filled(AMOUNTS, SHARE.replace("WHOLE", QUANTITIES).replace("UNIT", ", 'USD/piece' AS unit")))
def unit_price(spark, sf_dir):
    return t.unit_price(rows(spark, sf_dir, AMOUNTS), rows(spark, sf_dir, QUANTITIES), "USD", "piece")


AROUND = """SELECT series, round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) AS difference, n_before, n_after,
  CASE WHEN b IS NULL OR a IS NULL THEN 'EMPTY_SIDE' WHEN missing > 0 THEN 'EXCLUDED_MISSING' END AS flag
FROM (SELECT series, avg(value) FILTER (idx < 19738) AS b, avg(value) FILTER (idx >= 19738) AS a, count(value) FILTER (idx < 19738) AS n_before, count(value) FILTER (idx >= 19738) AS n_after, count(*) FILTER (value IS NULL) AS missing FROM f GROUP BY 1)"""


@query("before_after", filled(DAYS_DUCK, AROUND))
def before_after(spark, sf_dir):
    return t.before_after(rows(spark, sf_dir, DAYS), 19738)


@query("cohort_comparison", filled(MONTHS, """SELECT f.series, f.idx, round(f.value / b.value * 100, 9) AS value, CASE WHEN f.value IS NULL OR b.value IS NULL THEN 'MISSING_OR_GAP' END AS flag
FROM f LEFT JOIN (SELECT series, arg_min(value, idx) AS value FROM f WHERE value <> 0 GROUP BY 1) b ON b.series = f.series"""))
def cohort_comparison(spark, sf_dir):
    return t.cohort_comparison(rows(spark, sf_dir, MONTHS))


@query("lagged_comparison", f"""WITH p AS ({DAYS_DUCK}), every AS (SELECT DISTINCT a.series, b.series AS reference, lag FROM p a, p b, (SELECT unnest(generate_series(-5, 5)) AS lag) WHERE a.series <> 'view' AND b.series = 'view'), c AS (SELECT e.series, e.reference, e.lag, a.value AS x, b.value AS y FROM every e JOIN p a ON a.series = e.series JOIN p b ON b.series = e.reference AND b.idx = a.idx - e.lag WHERE a.value IS NOT NULL AND b.value IS NOT NULL)
SELECT e.series, e.reference, CAST(e.lag AS INT) AS lag, count(c.x) AS pairs, CASE WHEN count(c.x) >= 3 THEN round(corr(c.y, c.x), 12) END AS value, CASE WHEN count(c.x) < 3 THEN 'INSUFFICIENT_PAIRS' END AS flag FROM every e LEFT JOIN c USING (series, reference, lag) GROUP BY 1, 2, 3""")
def lagged_comparison(spark, sf_dir):
    days = rows(spark, sf_dir, DAYS)
    pairs = days.filter("series <> 'view'").select("series", F.lit("view").alias("reference")).distinct()
    return t.lagged_pairs(days, pairs, 5)


@query("control_comparison", filled(DAYS_DUCK, f""", c AS ({AROUND}) SELECT x.difference AS treated_change, y.difference AS reference_change, round(x.difference - y.difference, 6) AS difference FROM (SELECT * FROM c WHERE series = 'click') x FULL JOIN (SELECT * FROM c WHERE series = 'view') y ON true"""))
def control_comparison(spark, sf_dir):
    return t.control_comparison(rows(spark, sf_dir, DAYS), "click", "view", 19738)


@query("anomaly_candidate", filled(DAYS_DUCK, """, k AS (SELECT * FROM f WHERE value IS NOT NULL), m AS (SELECT series, median(value) AS middle, count(*) AS n FROM k GROUP BY 1), d AS (SELECT series, median(abs(value - middle)) AS mad FROM k JOIN m USING (series) GROUP BY 1),
z AS (SELECT f.series, idx, value, n, mad, CASE WHEN n >= 5 AND mad <> 0 THEN round(0.6745::DOUBLE * (value - middle) / mad, 9) END AS z FROM f LEFT JOIN m USING (series) LEFT JOIN d USING (series))
SELECT series, idx, z, coalesce(abs(z) > 3.5, false) AS candidate, CASE WHEN coalesce(n, 0) < 5 THEN 'INSUFFICIENT_POINTS' WHEN mad = 0 THEN 'ZERO_DISPERSION' WHEN value IS NULL THEN 'MISSING_OR_GAP' END AS flag FROM z"""))
def anomaly_candidate(spark, sf_dir):
    return t.anomaly_candidate(rows(spark, sf_dir, DAYS))


@query("change_point_candidate", f"""WITH p AS ({MONTHS}), c AS (SELECT series, idx, avg(value) OVER (PARTITION BY series) AS centre, value - avg(value) OVER (PARTITION BY series) AS x FROM p),
r AS (SELECT series, idx, centre, sum(x) OVER b AS s, sum(x * x) OVER b AS q, count(x) OVER b AS k, sum(x) OVER w AS ts, sum(x * x) OVER w AS tq, count(x) OVER w AS n FROM c WINDOW b AS (PARTITION BY series ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS (PARTITION BY series)),
s AS (SELECT *, round(1 - (q - s * s / k + tq - q - (ts - s) * (ts - s) / (n - k)) / tq, 9) AS score FROM r WHERE k >= 3 AND n - k >= 3),
b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, idx) AS j FROM s)
SELECT series, idx, score, round(centre + s / k, 6) AS before, round(centre + (ts - s) / (n - k), 6) AS after, CAST(NULL AS VARCHAR) AS flag FROM b WHERE j = 1""")
def change_point_candidate(spark, sf_dir):
    return t.change_point_candidate(rows(spark, sf_dir, MONTHS))


@query("derived_artifact", filled(MONTHS, ", r AS (" + POP.replace("LAG", "12") + ") SELECT 'derived:' || substring(sha256('orders-1|' || spec_hash), 1, 32) AS artifact_id, 'yoy' AS operation, 'orders' AS source_id, 'orders-1' AS source_hash, spec_hash, 'artifact:orders,temporal-operation:yoy@1:sha256:' || spec_hash AS refs, count(*) AS results, min(idx) AS first_idx, max(idx) AS last_idx FROM r, (SELECT sha256('{\"metric\":\"orders\",\"operation\":\"yoy\"}') AS spec_hash) GROUP BY spec_hash"))
def derived_artifact(spark, sf_dir):
    header = t.derived_artifact(t.yoy(rows(spark, sf_dir, MONTHS), "calendar-month"), "orders", "orders-1", {"operation": "yoy", "metric": "orders"})
    return header.withColumn("refs", F.array_join("refs", ","))
