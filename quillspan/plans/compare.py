"""Queries of comparison operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.operators import compare as c
from quillspan.plans.registry import query, rows

OBS = """SELECT concat(o_orderpriority, '/', o_orderstatus) AS series, CAST(year(o_orderdate) AS INT) AS ord, 'revenue' AS metric_id, CASE WHEN year(o_orderdate) >= 1999 AND o_orderstatus = 'O' THEN 'new' ELSE 'all' END AS population, CASE WHEN year(o_orderdate) = 1993 THEN concat(chr(123), '"b": 2, "a": 1', chr(125)) WHEN year(o_orderdate) = 1992 AND o_orderstatus = 'F' THEN concat(chr(123), '"a": 2, "b": 2', chr(125)) ELSE concat(chr(123), '"a": 1, "b": 2', chr(125)) END AS filters, CASE WHEN year(o_orderdate) = 1994 THEN 'p2' ELSE 'p1' END AS parameters,
  'h1' AS spec_hash, CASE WHEN year(o_orderdate) = 2000 AND o_orderpriority = '3-MEDIUM' THEN NULL ELSE 'JP' END AS geography, CASE WHEN year(o_orderdate) = 2000 AND o_orderpriority = '3-MEDIUM' THEN NULL ELSE 'nominal' END AS value_basis, CASE WHEN year(o_orderdate) = 2000 AND o_orderpriority = '3-MEDIUM' THEN NULL WHEN year(o_orderdate) = 1997 AND o_orderpriority = '1-URGENT' THEN 'estimated' ELSE 'observed' END AS origin, o_orderstatus AS dims, 'calendar-year' AS basis, make_date(CAST(year(o_orderdate) AS INT), 1, 1) AS start, make_date(CAST(year(o_orderdate) AS INT) + CASE WHEN o_orderpriority = '2-HIGH' AND year(o_orderdate) = 1996 THEN 2 ELSE 1 END, 1, 1) AS finish, CASE WHEN o_orderpriority = '2-HIGH' AND year(o_orderdate) = 1996 THEN 2 ELSE 1 END AS windows,
  CASE WHEN year(o_orderdate) = 1996 AND o_orderstatus = 'P' THEN NULL WHEN year(o_orderdate) = 1995 AND o_orderstatus = 'F' THEN 0 ELSE CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) END AS value, CASE WHEN year(o_orderdate) < 1998 THEN 's1' WHEN o_orderpriority = '3-MEDIUM' THEN ' ' ELSE 's2' END AS source, o_orderpriority = '5-LOW' AS flagged,
  'o1' AS id, CASE WHEN year(o_orderdate) = 2001 AND o_orderstatus = 'O' THEN ' ' ELSE 'a1' END AS analysis, CASE WHEN year(o_orderdate) = 1998 AND o_orderpriority = '5-LOW' THEN '' ELSE 'v1' END AS metric_version, CASE WHEN year(o_orderdate) = 1999 AND o_orderstatus = 'P' THEN 'other' ELSE 'revenue' END AS result_metric, DATE '2024-01-01' AS observed_at
FROM {orders} GROUP BY o_orderpriority, o_orderstatus, year(o_orderdate)"""
NAMES = "metric_id population filters parameters spec_hash geography value_basis origin dims basis start finish windows value source flagged id analysis metric_version result_metric observed_at"
PAIRED = f"WITH o AS ({OBS}), w AS (SELECT series, ord, " + ", ".join(f"{f}, lag({f}) OVER w AS p_{f}" for f in NAMES.split()) + """, row_number() OVER w AS k FROM o WINDOW w AS (PARTITION BY series ORDER BY ord)),
u AS (SELECT *, coalesce(geography, value_basis, origin) IS NULL OR coalesce(p_geography, p_value_basis, p_origin) IS NULL AS bare FROM w WHERE k > 1),
j AS (SELECT *, concat_ws(',', CASE WHEN trim(analysis) = '' OR trim(p_analysis) = '' THEN 'UNKNOWN_OBSERVATION_OWNERSHIP' END, CASE WHEN trim(source) = '' OR trim(p_source) = '' THEN 'INVALID_PROVENANCE' END,
  CASE WHEN metric_id <> p_metric_id OR metric_version = '' OR p_metric_version = '' OR metric_version <> p_metric_version THEN 'INCOMPATIBLE_METRIC' END, CASE WHEN population <> p_population THEN 'INCOMPATIBLE_POPULATION' END,
  CASE WHEN json_extract_string(filters, '$.a') <> json_extract_string(p_filters, '$.a') THEN 'INCOMPATIBLE_FILTERS' END, CASE WHEN parameters <> p_parameters THEN 'INCOMPATIBLE_PARAMETERS' END, CASE WHEN bare THEN 'MISSING_TEMPORAL_METADATA' END,
  CASE WHEN NOT bare AND origin IS DISTINCT FROM p_origin THEN 'INCOMPATIBLE_ORIGIN' END, CASE WHEN NOT bare AND (origin NOT IN ('observed', 'derived') OR p_origin NOT IN ('observed', 'derived')) THEN 'INVALID_TEMPORAL_EVIDENCE' END,
  CASE WHEN windows <> p_windows OR start < p_finish THEN 'INCOMPATIBLE_PERIOD' END, CASE WHEN result_metric <> metric_id OR p_result_metric <> p_metric_id THEN 'INVALID_METRIC_REFERENCE' END, CASE WHEN value IS NULL OR p_value IS NULL THEN 'MISSING_OR_NON_NUMERIC_VALUE' END) AS warnings FROM u)
"""
COMPARED = PAIRED + """SELECT series, ord, CASE WHEN warnings = '' THEN round(value - p_value, 4) END AS absolute, CASE WHEN warnings = '' THEN round((value - p_value) / nullif(abs(p_value), 0), 9) END AS relative,
  CASE WHEN warnings <> '' THEN 'unknown' WHEN value > p_value THEN 'increase' WHEN value < p_value THEN 'decrease' ELSE 'unchanged' END AS direction, warnings,
  CASE WHEN warnings = '' THEN concat_ws(',', CASE WHEN p_value = 0 THEN 'ZERO_BASELINE' END, CASE WHEN source IS DISTINCT FROM p_source THEN 'SOURCE_CHANGED' END, CASE WHEN flagged OR p_flagged THEN 'QUALITY_FLAGS_PRESENT' END) ELSE '' END AS review FROM j"""
FIELDS = [*[f for f, _ in c.INCOMPATIBLE], *c.PERIOD, "value", "source", "flagged", *c.OWN]


@query("compare_observations", COMPARED)
def compare_observations(spark, sf_dir):
    obs = rows(spark, sf_dir, OBS).withColumnRenamed("finish", "end")
    own = obs.select("series", "ord", F.struct(*FIELDS).alias("cur"))
    steps = obs.select("series", "ord").distinct()
    prev = steps.withColumn("prev_ord", F.lag("ord").over(Window.partitionBy("series").orderBy("ord"))).filter("prev_ord is not null")
    pairs = prev.join(own, ["series", "ord"]).join(own.select("series", F.col("ord").alias("prev_ord"), F.col("cur").alias("prev")), ["series", "prev_ord"])
    return c.compare_pairs(pairs).select("series", "ord", "absolute", "relative", "direction", "warnings", "review")


@query("compare_series", COMPARED)
def compare_series(spark, sf_dir):
    return c.compare_series(rows(spark, sf_dir, OBS).withColumnRenamed("finish", "end"), "series", "ord").select("series", "ord", "absolute", "relative", "direction", "warnings", "review")


DOCS = "SELECT doc_id AS id, 'x' AS source, text AS content, lang AS metadata FROM {documents}"


@query("collapse_copies", f"SELECT id, min(id) OVER w AS kept_id, count(*) OVER w AS copies, id = min(id) OVER w AS kept FROM ({DOCS}) WINDOW w AS (PARTITION BY source, content, metadata)")
def collapse_copies(spark, sf_dir):
    return c.collapse_copies(rows(spark, sf_dir, DOCS))


COUNTED = "SELECT doc_id AS id, text AS content, CASE WHEN doc_id % 7 = 0 THEN 'many' WHEN doc_id % 11 = 0 THEN '-4' ELSE CAST(n_chars AS STRING) END AS record_count FROM {documents}"


@query("dataset_observations", f"SELECT id, CASE WHEN ok THEN CAST(record_count AS BIGINT) END AS value, CASE WHEN ok THEN regexp_extract(content, '(?s)^(.*?[.])', 1) END AS quote, CASE WHEN NOT ok THEN 'BAD_RECORD_COUNT' END AS note FROM (SELECT *, regexp_full_match(record_count, '[0-9]+') AS ok FROM ({COUNTED}))")
def dataset_observations(spark, sf_dir):
    return c.dataset_observations(rows(spark, sf_dir, COUNTED))


POINTS = "SELECT event_type AS series, CAST(CAST(ts AS DATE) AS STRING) AS period, CAST(count(*) AS BIGINT) AS value FROM {events} GROUP BY 1, 2 UNION ALL SELECT 'error', '2024-01-05', 1"
COMPARISONS = f"WITH p AS ({POINTS}), d AS (SELECT DISTINCT series FROM p GROUP BY series, period HAVING count(*) > 1), g AS (SELECT * FROM p ANTI JOIN d USING (series))\n"


@query("dataset_comparisons", COMPARISONS + """SELECT series, period, value, value - lag(value) OVER w AS delta, round((value - lag(value) OVER w) / nullif(lag(value) OVER w, 0), 9) AS rate, value - first_value(value) OVER w AS from_baseline,
  round(value / sum(value) OVER (PARTITION BY series), 9) AS share, CAST(NULL AS VARCHAR) AS note FROM g WINDOW w AS (PARTITION BY series ORDER BY period) UNION ALL SELECT series, NULL, NULL, NULL, NULL, NULL, NULL, 'DUPLICATE_PERIOD' FROM d""")
def dataset_comparisons(spark, sf_dir):
    return c.dataset_comparisons(rows(spark, sf_dir, POINTS))


STEPS = "SELECT series, period, lag(period) OVER (PARTITION BY series ORDER BY period) AS prev_period, value - lag(value) OVER (PARTITION BY series ORDER BY period) AS delta FROM (SELECT event_type AS series, CAST(CAST(ts AS DATE) AS STRING) AS period, CAST(count(*) AS BIGINT) AS value FROM {events} GROUP BY 1, 2)"
NAMED = "SELECT event_type AS series, CAST(CAST(ts AS DATE) AS STRING) AS period, min(event_id) AS id FROM {events} GROUP BY 1, 2"


@query("comparison_patterns", f"WITH s AS ({STEPS}), o AS ({NAMED}) SELECT s.series, s.period, a.id AS from_id, b.id AS to_id, s.series || ' changed by ' || s.delta || ' from ' || s.prev_period || ' to ' || s.period AS text FROM s JOIN o a ON a.series = s.series AND a.period = s.prev_period JOIN o b ON b.series = s.series AND b.period = s.period")
def comparison_patterns(spark, sf_dir):
    return c.comparison_patterns(rows(spark, sf_dir, STEPS).filter("prev_period is not null"), rows(spark, sf_dir, NAMED))


MANIFESTS = "SELECT p_brand AS project, p_partkey AS dataset_id, CASE p_partkey % 3 WHEN 0 THEN 'Piece' WHEN 1 THEN '' ELSE ' kg ' END AS unit, CASE WHEN p_partkey % 5 = 0 THEN 'P1' WHEN p_partkey % 5 = 1 THEN 'p1' ELSE '' END AS population_id, CASE WHEN p_partkey % 7 = 0 THEN lower(p_type) ELSE p_type END AS population, CASE WHEN p_size > 40 THEN '2021..2024' WHEN p_size > 25 THEN '2026-01/2026-06' WHEN p_size > 10 THEN 'spring' ELSE ' 2024-01-05 ' END AS period, CASE WHEN p_size % 2 = 0 THEN 's1' ELSE 's2' END AS schema_id, CASE WHEN p_size % 4 = 0 THEN 'v1' WHEN p_size % 4 = 1 THEN 'V1 ' ELSE 'v2' END AS schema_version FROM {part}"
CLASSES = f"""WITH m AS (SELECT project, dataset_id, nullif(lower(trim(unit)), '') AS unit, nullif(population_id, '') AS population_id, lower(population) AS population, CASE trim(period) WHEN '2021..2024' THEN 'year' WHEN '2026-01/2026-06' THEN 'month' WHEN '2024-01-05' THEN 'day' END AS granularity, schema_id, lower(trim(schema_version)) AS schema_version FROM ({MANIFESTS})),
k AS (SELECT project, min(dataset_id) AS class, count(*) AS n, unit, population_id, population, granularity, schema_id, schema_version FROM m GROUP BY ALL)
"""


@query("manifest_compatibility", CLASSES + """SELECT * FROM (SELECT x.project, x.class AS a, y.class AS b, x.n * y.n AS pairs, concat_ws(',', CASE WHEN x.unit <> y.unit THEN 'UNIT_MISMATCH' END,
  CASE WHEN x.population_id IS NOT NULL AND y.population_id IS NOT NULL THEN CASE WHEN x.population_id <> y.population_id THEN 'POPULATION_MISMATCH' END WHEN x.population <> y.population THEN 'POPULATION_MISMATCH' END,
  CASE WHEN x.granularity <> y.granularity THEN 'GRANULARITY_MISMATCH' END, CASE WHEN x.schema_id = y.schema_id AND x.schema_version <> y.schema_version THEN 'SCHEMA_VERSION_MISMATCH' END) AS warnings FROM k x JOIN k y ON x.project = y.project AND x.class < y.class) WHERE warnings <> ''""")
def manifest_compatibility(spark, sf_dir):
    return c.manifest_compatibility(c.manifest_classes(rows(spark, sf_dir, MANIFESTS)))


@query("manifest_classes", CLASSES + "SELECT m.project, m.dataset_id, k.class FROM m JOIN k ON m.project = k.project AND m.unit IS NOT DISTINCT FROM k.unit AND m.population_id IS NOT DISTINCT FROM k.population_id AND m.population = k.population AND m.granularity IS NOT DISTINCT FROM k.granularity AND m.schema_id = k.schema_id AND m.schema_version = k.schema_version")
def manifest_classes(spark, sf_dir):
    return c.manifest_classes(rows(spark, sf_dir, MANIFESTS)).select("project", "dataset_id", "class")


FILES = "SELECT c_custkey AS dataset_id, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS source_name, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 's1' END AS schema_id, CASE c_custkey % 5 WHEN 0 THEN 'api' WHEN 1 THEN 'fixture' WHEN 2 THEN 'scrape' WHEN 3 THEN 'manual_export' ELSE NULL END AS method, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '2024-01-01' END AS retrieved_at, CASE c_custkey % 7 WHEN 0 THEN 'Api_Key' WHEN 1 THEN 'app_id' WHEN 2 THEN 'credential' WHEN 3 THEN 'id' ELSE 'ideal' END AS k, CASE c_custkey % 11 WHEN 0 THEN 'http://x/y?a=1&accessToken=z' WHEN 1 THEN 'http://x/y?id=7#id' WHEN 2 THEN NULL ELSE 'http://x/token?year=1#key=2' END AS url FROM {customer}"
BROKEN = {"SOURCE_NAME_REQUIRED": "trim(source_name) = ''", "METHOD_REQUIRED": "method IS NULL", "UNKNOWN_METHOD": "method = 'scrape'", "RETRIEVED_AT_REQUIRED": "retrieved_at = ''", "SCHEMA_ID_REQUIRED": "schema_id IS NULL", "CREDENTIAL_PARAMETER": "k <> 'ideal'", "CREDENTIAL_IN_URL": "url LIKE '%accessToken=%' OR url LIKE '%?id=%'"}


@query("manifest_validate", f"WITH m AS ({FILES}) " + " UNION ALL ".join(f"SELECT dataset_id, '{k}' AS code FROM m WHERE {v}" for k, v in BROKEN.items()))
def manifest_validate(spark, sf_dir):
    return c.manifest_validate(rows(spark, sf_dir, FILES).withColumn("parameters", F.create_map("k", F.lit("v"))))


LABELLED = "SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag AS pa, CASE WHEN l_linenumber = 2 THEN NULL WHEN l_linenumber = 3 THEN 'N' ELSE l_returnflag END AS pb, 'observed' AS ma, CASE WHEN l_linestatus = 'O' THEN 'observed' ELSE 'harmonized' END AS mb FROM {lineitem}"


@query("comparability_label", f"SELECT id, line, CASE WHEN pa = pb AND mb = 'observed' THEN 'COMPARABLE' WHEN pa = pb THEN 'HARMONIZED_REFERENCE' ELSE 'NOT_COMPARABLE' END AS label FROM ({LABELLED})")
def comparability_label(spark, sf_dir):
    return rows(spark, sf_dir, LABELLED).select("id", "line", c.comparability_label(F.col("pa"), F.col("pb"), F.col("ma"), F.col("mb")).alias("label"))


RECORDS = "SELECT o_orderpriority AS metric_id, CAST(year(o_orderdate) AS STRING) AS period, o_orderstatus AS geography, CAST(count(*) * CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 10000000019 ELSE 1 END AS DECIMAL(18,0)) AS value FROM {orders} GROUP BY o_orderpriority, year(o_orderdate), o_orderstatus UNION ALL SELECT '5-LOW', '1996', 'F', CAST(1 AS DECIMAL(18,0))"


@query("pct_change_report", f"SELECT metric_id, geography, CASE WHEN ok THEN CAST(a - b AS BIGINT) END AS delta, CASE WHEN ok THEN sign(a - b) * ((2000 * abs(CAST(a - b AS HUGEINT)) + CAST(b AS HUGEINT)) // (2 * CAST(b AS HUGEINT))) / 10.0::DOUBLE END AS percent, CASE WHEN NOT ok THEN 'NOT_EXACTLY_ONE_RECORD' END AS error FROM (SELECT metric_id, geography, count(*) FILTER (period = '1996') = 1 AND count(*) FILTER (period = '1997') = 1 AS ok, max(value) FILTER (period = '1996') AS b, max(value) FILTER (period = '1997') AS a FROM ({RECORDS}) GROUP BY 1, 2)")
def pct_change_report(spark, sf_dir):
    found = c.pct_change_report(rows(spark, sf_dir, RECORDS), "1996", "1997")
    return found.withColumns({"delta": F.col("delta").cast("long"), "percent": F.col("percent").cast("double")})


CLAIMS = f"SELECT id AS claim_id, CASE WHEN id % 2 = 0 THEN 'COMPARABLE' ELSE 'NOT_COMPARABLE' END AS stated, CASE WHEN pa = pb AND mb = 'observed' THEN 'COMPARABLE' WHEN pa = pb THEN 'HARMONIZED_REFERENCE' ELSE 'NOT_COMPARABLE' END AS label FROM ({LABELLED})"


@query("weakest_comparability", f"SELECT claim_id, weakest, stated, weakest <> stated AS violation FROM (SELECT claim_id, min(stated) AS stated, CASE WHEN bool_or(label = 'NOT_COMPARABLE') THEN 'NOT_COMPARABLE' WHEN bool_or(label = 'HARMONIZED_REFERENCE') THEN 'HARMONIZED_REFERENCE' ELSE 'COMPARABLE' END AS weakest FROM ({CLAIMS}) GROUP BY 1)")
def weakest_comparability(spark, sf_dir):
    return c.weakest_comparability(rows(spark, sf_dir, CLAIMS))


PARTS = "SELECT c_mktsegment AS part, CAST(year(o_orderdate) AS STRING) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS value FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment, year(o_orderdate)"
WHOLES = "SELECT CAST(year(o_orderdate) AS STRING) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS value FROM {orders} GROUP BY year(o_orderdate)"
CENTS = f"SELECT part, CAST(max(p.value) FILTER (period = '1996') * 100 AS HUGEINT) AS pb, CAST(max(w.value) FILTER (period = '1996') * 100 AS HUGEINT) AS wb, CAST(max(p.value) FILTER (period = '2000') * 100 AS HUGEINT) AS pa, CAST(max(w.value) FILTER (period = '2000') * 100 AS HUGEINT) AS wa FROM ({PARTS}) p JOIN ({WHOLES}) w USING (period) GROUP BY 1"


@query("concentration_share", f"SELECT part, ((20000 * pb + wb) // (2 * wb)) / 100.0::DOUBLE AS share_before, ((20000 * pa + wa) // (2 * wa)) / 100.0::DOUBLE AS share_after, sign(pa * wb - pb * wa) * ((20000 * abs(pa * wb - pb * wa) + wa * wb) // (2 * wa * wb)) / 100.0::DOUBLE AS points FROM ({CENTS})")
def concentration_share(spark, sf_dir):
    found = c.concentration_share(rows(spark, sf_dir, PARTS), rows(spark, sf_dir, WHOLES), "1996", "2000")
    return found.select("part", *[F.col(n).cast("double").alias(n) for n in ("share_before", "share_after", "points")])


DIFFERENCES = "SELECT c_custkey AS id, CAST(count(*) AS BIGINT) AS naive, CAST(count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS BIGINT) AS excluded FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY 1"


@query("gap_decomposition", f"SELECT id, naive, excluded, naive - excluded AS within_scope, round(excluded / naive, 6) AS excluded_share, round((naive - excluded) / naive, 6) AS within_share FROM ({DIFFERENCES})")
def gap_decomposition(spark, sf_dir):
    return c.gap_decomposition(rows(spark, sf_dir, DIFFERENCES))


LATEST = "SELECT o_orderkey AS id, CAST(o_custkey AS STRING) AS series, substring(CAST(o_orderdate AS STRING), 1, 4) AS period_end, o_totalprice AS value FROM {orders}"


@query("latest_by_series", f"SELECT series, id, period_end, value FROM ({LATEST}) QUALIFY row_number() OVER (PARTITION BY series ORDER BY period_end DESC, id DESC) = 1")
def latest_by_series(spark, sf_dir):
    return c.latest_by_series(rows(spark, sf_dir, LATEST))


RUNS = "SELECT CAST(o_orderkey % 4 AS INT) AS run, CAST(o_custkey % 300 AS STRING) AS series, CASE WHEN o_orderkey % 4 = 3 AND o_custkey % 5 = 0 THEN 'v2' ELSE 'v1' END AS definition, substring(CAST(o_orderdate AS STRING), 1, 4) AS period_end, o_totalprice AS value, o_orderkey AS id FROM {orders}"


@query("run_observation_deltas", f"""WITH l AS (SELECT * FROM ({RUNS}) QUALIFY row_number() OVER (PARTITION BY run, series ORDER BY period_end DESC, id DESC) = 1), p AS (SELECT l.*, b.definition AS pd, b.period_end AS pp, b.value AS pv FROM l JOIN l b ON b.series = l.series AND b.run = l.run - 1)
SELECT run, series, CASE WHEN period_end = pp THEN 'RESTATED' WHEN definition <> pd THEN 'DEFINITION_CHANGED' ELSE 'DELTA' END AS kind, CASE WHEN definition = pd THEN round(value - pv, 4) END AS delta FROM p WHERE period_end <> pp OR value <> pv""")
def run_observation_deltas(spark, sf_dir):
    return c.run_observation_deltas(rows(spark, sf_dir, RUNS))
