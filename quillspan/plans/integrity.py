"""Queries of artifact checks and data-quality jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import cases
from quillspan.operators import integrity as g
from quillspan.plans.registry import query, rows

SCHEMA = ("result-artifact", "1")
ARTIFACTS = "SELECT c_custkey AS artifact_id, CASE WHEN c_custkey % 31 = 0 THEN 'other' ELSE 'result-artifact' END AS schema, CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE '1' END AS version, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE c_name END AS producer, '1.0' AS producer_version, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE DATE '2024-01-01' END AS generated_at, CASE WHEN c_custkey % 7 = 0 THEN 'xyz' ELSE sha2(c_name, 256) END AS artifact_hash, CASE WHEN c_custkey % 4 = 0 THEN 'ns' END AS subject_namespace, CASE WHEN c_custkey % 8 = 0 THEN c_name END AS subject_id, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'sql' END AS spec_kind, c_name AS spec_reference, CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE sha2(c_mktsegment, 256) END AS spec_hash, '1995-01' AS period_start, CASE WHEN c_custkey % 11 = 0 THEN '1994-12' ELSE '2001-12' END AS period_end, CASE WHEN c_custkey % 14 = 0 THEN ' ' ELSE c_mktsegment END AS population, 'spark' AS engine, '4' AS engine_version, c_custkey % 15 > 0 AS deterministic FROM {customer}"
METRICS = "SELECT o_custkey AS artifact_id, o_orderpriority AS metric_id, CASE WHEN o_orderkey % 21 = 0 THEN '' ELSE 'total' END AS name, 'USD' AS unit FROM {orders} WHERE o_orderstatus <> 'O'"
RESULTS = "SELECT o_custkey AS artifact_id, o_orderpriority AS metric_id, substring(CAST(o_orderdate AS STRING), 1, 7) AS period_start, CASE WHEN o_orderkey % 17 = 0 THEN '1990-01' ELSE '2002-01' END AS period_end, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS value, o_orderkey % 26 = 0 AS missing FROM {orders} WHERE o_orderstatus <> 'P'"
DATASETS = "SELECT o_custkey AS artifact_id, o_orderstatus AS dataset_id, CASE WHEN o_orderkey % 16 = 0 THEN NULL ELSE 'v1' END AS version, CASE WHEN o_orderkey % 18 = 0 THEN 'abc' ELSE sha2(o_orderpriority, 256) END AS hash FROM {orders} WHERE o_orderpriority <> '1-URGENT'"
PROVENANCE = "SELECT o_custkey AS artifact_id, o_orderstatus AS dataset_id, CASE WHEN o_orderkey % 19 = 0 THEN ' ' ELSE o_orderpriority END AS source, CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderdate END AS retrieved_at FROM {orders} WHERE o_orderpriority <> '2-HIGH'"
DUCK = {n: t.replace("sha2(c_name, 256)", "sha256(c_name)").replace("sha2(c_mktsegment, 256)", "sha256(c_mktsegment)").replace("sha2(o_orderpriority, 256)", "sha256(o_orderpriority)") for n, t in (("a", ARTIFACTS), ("m", METRICS), ("r", RESULTS), ("d", DATASETS), ("p", PROVENANCE))}
REFERENCES = """SELECT DISTINCT artifact_id, 'UNKNOWN_DATASET' AS code FROM p ANTI JOIN d USING (artifact_id, dataset_id) UNION ALL SELECT DISTINCT artifact_id, 'DATASET_WITHOUT_PROVENANCE' FROM d ANTI JOIN p USING (artifact_id, dataset_id)"""
RULES_OF = {
    "a": {"UNSUPPORTED_SCHEMA": "schema <> 'result-artifact' OR version IS NULL", "PRODUCER_REQUIRED": "trim(producer) = '' OR generated_at IS NULL", "SUBJECT_INCOMPLETE": "(subject_namespace IS NOT NULL) <> (subject_id IS NOT NULL)", "BAD_HASH": "artifact_hash = 'xyz'", "SPEC_REQUIRED": "spec_kind = ''", "BAD_SPEC_HASH": "spec_hash IS NULL", "BAD_PERIOD": "period_start > period_end", "POPULATION_REQUIRED": "trim(population) = ''", "COMPUTATION_REQUIRED": "NOT deterministic"}
    | {f"{k}_REQUIRED": f"artifact_id NOT IN (SELECT artifact_id FROM {t})" for k, t in (("DATASETS", "d"), ("METRICS", "m"), ("RESULTS", "r"), ("PROVENANCE", "p"))},
    "d": {"DATASET_INCOMPLETE": "version IS NULL", "BAD_DATASET_HASH": "hash = 'abc'"},
    "m": {"METRIC_INCOMPLETE": "name = ''"},
    "r": {"BAD_RESULT_PERIOD": "period_start > period_end", "MISSING_MISMATCH": "missing = (value IS NOT NULL)"},
    "p": {"PROVENANCE_INCOMPLETE": "trim(source) = '' OR retrieved_at IS NULL"},
}
JUDGED = [f"SELECT artifact_id, '{code}' AS code FROM {t} WHERE {when}" for t, codes in RULES_OF.items() for code, when in codes.items()]


@query("validate_artifacts", "WITH " + ", ".join(f"{n} AS ({t})" for n, t in DUCK.items()) + " SELECT DISTINCT artifact_id, code FROM (" + " UNION ALL ".join(JUDGED) + f""" UNION ALL SELECT artifact_id, 'DUPLICATE_METRIC' FROM m GROUP BY artifact_id, metric_id HAVING count(*) > 1 UNION ALL SELECT artifact_id, 'DUPLICATE_DATASET' FROM d GROUP BY artifact_id, dataset_id HAVING count(*) > 1
UNION ALL SELECT artifact_id, 'UNKNOWN_METRIC' FROM r ANTI JOIN m USING (artifact_id, metric_id) UNION ALL {REFERENCES})""")
def validate_artifacts(spark, sf_dir):
    return g.validate_artifacts(*(rows(spark, sf_dir, t) for t in (ARTIFACTS, METRICS, RESULTS, DATASETS, PROVENANCE)), SCHEMA)


@query("validate_provenance", f"WITH d AS ({DUCK['d']}), p AS ({PROVENANCE}) {REFERENCES}")
def validate_provenance(spark, sf_dir):
    return g.validate_provenance(rows(spark, sf_dir, DATASETS), rows(spark, sf_dir, PROVENANCE))


TEMPORAL = """SELECT o_custkey AS artifact_id, o_orderkey AS idx, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '2024-01-01' END AS observed_at, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'JP' END AS geography, CASE WHEN o_orderkey % 11 = 0 THEN 'estimated' ELSE 'observed' END AS origin,
  CASE WHEN o_orderkey % 17 = 0 THEN 'bogus' ELSE 'nominal' END AS value_basis, CASE WHEN o_orderkey % 19 = 0 THEN ' ' ELSE '1' END AS metric_version, CASE o_orderpriority WHEN '1-URGENT' THEN 'calendar-year' WHEN '2-HIGH' THEN 'calendar-day' WHEN '5-LOW' THEN '' ELSE 'calendar-month' END AS basis,
  CASE WHEN o_orderkey % 13 = 0 THEN 'spring' ELSE substring(CAST(o_orderdate AS STRING), 1, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 10 ELSE 7 END) END AS label, o_orderdate FROM {orders}"""
HEADERS = "SELECT c_custkey AS artifact_id, 'calendar-month' AS artifact_basis, '1996-01' AS low, '2000-12' AS high FROM {customer}"
TEMPORAL_CODES = {"OBSERVED_AT_REQUIRED": "observed_at = ''", "GEOGRAPHY_REQUIRED": "geography IS NULL", "UNKNOWN_ORIGIN": "origin = 'estimated'", "UNKNOWN_VALUE_BASIS": "value_basis = 'bogus'", "METRIC_VERSION_REQUIRED": "metric_version = ' '", "BAD_LABEL": "label = 'spring'", "OUTSIDE_WINDOW": "label <> 'spring' AND year(o_orderdate) NOT BETWEEN 1996 AND 2000"}


@query("validate_temporal", f"WITH t AS (SELECT * FROM ({TEMPORAL}) JOIN ({HEADERS}) USING (artifact_id)) " + " UNION ALL ".join(f"SELECT artifact_id, idx, '{k}' AS code FROM t WHERE {v}" for k, v in TEMPORAL_CODES.items()))
def validate_temporal(spark, sf_dir):
    results = rows(spark, sf_dir, TEMPORAL).withColumn("start", F.col("label")).withColumn("finish", F.col("label"))
    return g.validate_temporal(results, rows(spark, sf_dir, HEADERS))


VERSIONS = "SELECT o_custkey AS artifact_id, CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN 'AB' ELSE 'ab' END AS artifact_hash FROM {orders}"


@query("artifact_conflicts", f"SELECT artifact_id, count(*) AS n, CASE WHEN count(DISTINCT lower(artifact_hash)) > 1 THEN 'CONFLICT' ELSE 'DUPLICATE' END AS kind FROM ({VERSIONS}) GROUP BY 1 HAVING count(*) > 1")
def artifact_conflicts(spark, sf_dir):
    return g.artifact_conflicts(rows(spark, sf_dir, VERSIONS))


PARTS = "SELECT o_custkey AS artifact_id, o_orderstatus AS kind, CAST(o_orderkey AS STRING) AS value FROM {orders}"


@query("reproducibility_key", f"SELECT artifact_id, sha256(string_agg(kind || '=' || value, chr(31) ORDER BY kind || '=' || value)) AS key FROM ({PARTS}) GROUP BY 1")
def reproducibility_key(spark, sf_dir):
    return g.reproducibility_key(rows(spark, sf_dir, PARTS))


FACTS = "SELECT o_orderpriority AS metric_id, substring(CAST(o_orderdate AS STRING), 1, 7) AS period, o_orderstatus AS dims, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE sum(CAST(o_totalprice AS DECIMAL(18,2))) END AS value FROM {orders} GROUP BY 1, 2, 3"
NAMES = "SELECT DISTINCT o_orderpriority AS metric_id, lower(o_orderpriority) AS name, 'USD' AS unit FROM {orders}"
STATED = f"WITH s AS (SELECT sha256(concat_ws('|', 'run-1', metric_id, period, dims)) AS statement_id, metric_id, period, dims, name || ' = ' || coalesce(CAST(CAST(value AS DECIMAL(30,2)) AS VARCHAR), 'unknown') || ' ' || unit || ' for ' || period || ' (' || dims || ')' AS statement FROM ({FACTS}) JOIN ({NAMES}) USING (metric_id))\n"


@query("result_statements", STATED + "SELECT * FROM s")
def result_statements(spark, sf_dir):
    return g.result_statements(rows(spark, sf_dir, FACTS), rows(spark, sf_dir, NAMES), "run-1")


@query("artifact_document", STATED + "SELECT metric_id, string_agg(statement, chr(10) ORDER BY period, dims) AS content, count(*) AS lines FROM s GROUP BY 1")
def artifact_document(spark, sf_dir):
    return g.artifact_document(result_statements(spark, sf_dir))


#: A case an order: its lines are the rows of two datasets, each later line is compared with the first.
CASES = """SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS population, CASE WHEN o_orderkey % 2 = 0 THEN 50 ELSE 200 END AS base, l_linenumber AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(14,2)) AS v
FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 5"""
VERDICT = "CASE WHEN k % 31 = 0 THEN 'PROVEN' WHEN k % 5 = 0 THEN 'INCONCLUSIVE' WHEN k % 5 = 1 THEN 'ASSOCIATION_ONLY' WHEN k % 5 = 2 THEN 'SUPPORTED_WITH_LIMITS' WHEN k % 5 = 3 THEN 'NOT_COMPARABLE' ELSE 'COMPETING_UNRESOLVED' END"
DELTA, PERCENT = "CAST(v - base + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS DECIMAL(14,2))", "CAST(round(CAST((v - base) * CASE WHEN base = 50 THEN 2.0 ELSE 0.5 END AS DECIMAL(20,3)), 1) + CASE WHEN k % 11 = 0 THEN 0.1 ELSE 0.0 END AS DECIMAL(20,1))"


def nested(rows_):
    """The orders as case JSON (id, body)."""
    line = F.struct(F.col("n").cast("string").alias("key"), F.col("v").alias("value"))
    compared = F.expr(f"""named_struct('id', concat('C', n), 'baselineDatasetId', 'ds-g', 'baselineRowKey', CASE WHEN k % 13 = 0 AND n = 2 THEN 'none' ELSE 'first' END, 'currentDatasetId', 'ds-v', 'currentRowKey', CAST(n AS STRING),
        'expectedDelta', {DELTA}, 'expectedPctChange', CAST({PERCENT} AS STRING), 'comparabilityLabel', CASE WHEN k % 3 = 0 AND c % 11 <> 0 THEN 'NOT_COMPARABLE' WHEN k % 5 = 0 THEN 'HARMONIZED_REFERENCE' ELSE 'COMPARABLE' END)""")
    orders = rows_.groupBy("k", "c", "population", "base").agg(F.collect_list(line).alias("lines"), F.collect_list(F.when(F.col("n") > 1, compared)).alias("comparisons"))
    body = f"""to_json(named_struct('caseId', CAST(k AS STRING), 'version', '1', 'title', 't', 'kind', CASE WHEN k % 37 > 0 THEN 'synthetic' END, 'goldenSetIndex', 1, 'dimensions', array('d'),
      'humanReview', named_struct('status', CASE k % 12 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'x' ELSE 'PASS' END),
      'input', named_struct('researchQuestion', 'q', 'stage', 'EXPLORATORY', 'datasets', array(
        named_struct('id', 'ds-g', 'role', 'hypothesis_generation', 'sourceKind', 'primary', 'populationDefinitionId', population, 'harmonizationMethod', 'observed', 'rows', array(named_struct('key', 'first', 'value', CAST(base AS DECIMAL(12,2))))),
        named_struct('id', 'ds-v', 'role', 'validation', 'sourceKind', 'primary', 'populationDefinitionId', CASE WHEN k % 3 = 0 THEN 'other' ELSE population END, 'harmonizationMethod', CASE WHEN k % 5 = 0 THEN 'modelled' END, 'rows', lines))),
      'expected', named_struct('verdict', {VERDICT}, 'comparisons', comparisons,
        'expectations', array(named_struct('id', 'E1', 'basis', 'MODEL_PROPOSED', 'provenance', CASE WHEN k % 3 = 0 THEN 'PRIOR' ELSE 'POST_HOC' END, 'declaredBeforeDataSeen', true), named_struct('id', 'E2', 'basis', 'SOURCE_BACKED', 'provenance', 'PRIOR', 'declaredBeforeDataSeen', k % 4 <> 0)),
        'hypotheses', array(named_struct('id', 'H1', 'role', 'PRIMARY', 'validationStatus', 'PLAUSIBLE', 'causalStatus', CASE WHEN c % 4 = 0 THEN 'CAUSALLY_SUPPORTED' ELSE 'OBSERVED_ASSOCIATION' END, 'identificationStatus', CASE WHEN c % 3 = 0 THEN 'IDENTIFIED' ELSE 'NOT_IDENTIFIED' END)),
        'evidence', array(named_struct('id', 'V1', 'type', CASE WHEN k % 6 = 0 THEN 'counter' ELSE 'support' END, 'datasetId', 'ds-g', 'usage', CASE WHEN c % 5 = 0 THEN 'independent_validation' ELSE 'generation' END, 'sourceKind', 'primary', 'traceableToPrimary', true),
          named_struct('id', 'V2', 'type', 'neutral', 'datasetId', CASE WHEN c % 7 = 0 THEN 'ds-x' ELSE 'ds-v' END, 'usage', 're_analysis', 'sourceKind', CASE WHEN k % 9 = 0 THEN 'ai_output' ELSE 'primary' END, 'traceableToPrimary', c % 2 = 0)),
        'counterEvidenceSearched', k % 8 <> 0, 'mayClaimExhaustiveValidation', c % 6 = 0, 'requiresCounterEvidence', c % 8 = 0,
        'requiredLimitations', filter(array('x'), x -> k % 10 <> 0), 'forbiddenClaims', filter(array('y'), x -> c % 9 <> 0), 'requiredResearchGaps', filter(array(named_struct('category', 'OTHER')), x -> c % 10 <> 0))))"""
    return orders.select(F.col("k").alias("id"), F.expr(body).alias("body"))


#: The same rules over the orders themselves: the item that breaks each, if any.
ONE_EACH = {
    "SCHEMA": ("CASE WHEN k % 31 = 0 THEN 'expected.verdict' END", "CASE WHEN k % 37 = 0 THEN 'kind' END"),
    "EXPECTATION_PROVENANCE": ("CASE WHEN k % 3 = 0 THEN 'E1' END", "CASE WHEN k % 4 = 0 THEN 'E2' END"),
    "STAGE_SEPARATION": ("CASE WHEN c % 5 = 0 THEN 'V1' END", "CASE WHEN c % 7 = 0 THEN 'V2' END"),
    "CONFIDENCE_IS_NOT_CAUSAL": ("CASE WHEN (k % 5 <> 2 AND (c % 4 = 0 OR c % 3 = 0)) OR (c % 4 <> 0 AND c % 3 = 0) THEN 'H1' END",),
    "COUNTER_EVIDENCE": ("CASE WHEN c % 8 = 0 AND k % 6 <> 0 THEN 'no_counter' END", "CASE WHEN k % 8 = 0 AND c % 6 = 0 THEN 'no_search' END"),
    "INCONCLUSIVE_IS_VALID": ("CASE WHEN k % 5 = 0 AND c % 9 = 0 THEN 'forbiddenClaims' END", "CASE WHEN k % 10 = 0 THEN 'requiredLimitations' END"),
    "IDENTIFICATION_GAP_VISIBLE": ("CASE WHEN c % 3 <> 0 AND c % 10 = 0 THEN 'H1' END",),
    "EXTERNAL_ARTIFACT_NOT_PRIMARY": ("CASE WHEN k % 9 = 0 AND c % 2 <> 0 AND c % 7 <> 0 THEN 'V2' END",),
    "HUMAN_REVIEW": ("CASE k % 12 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'x' END",),
}
#: And of comparisons, over their lines.
EACH_LINE = {
    "COMPARABILITY": "n > 1 AND NOT (k % 13 = 0 AND n = 2) AND k % 3 = 0 AND c % 11 = 0",
    "DETERMINISTIC_CALCULATION": "n > 1 AND ((k % 13 = 0 AND n = 2) OR k % 7 = 0 OR k % 11 = 0)",
}


@query("case_invariants", f"WITH l AS ({CASES}), o AS (SELECT DISTINCT k, c FROM l), r AS (" + " UNION ALL ".join([f"SELECT k AS id, '{rule}' AS rule, concat_ws(',', {', '.join(items)}) AS broken FROM o" for rule, items in ONE_EACH.items()] + [f"SELECT k, '{rule}', coalesce(string_agg('C' || n, ',' ORDER BY 'C' || n) FILTER ({bad}), '') FROM l GROUP BY k" for rule, bad in EACH_LINE.items()]) + ") SELECT id, rule, CASE WHEN broken = '' THEN 'PASS' WHEN broken = 'PENDING' THEN 'WARN' ELSE 'FAIL' END AS outcome, broken FROM r WHERE rule = 'SCHEMA' OR (id % 31 <> 0 AND id % 37 <> 0)")
def case_invariants(spark, sf_dir):
    return cases.case_invariants(nested(rows(spark, sf_dir, CASES)))


REPORTS = "SELECT doc_id AS id, doc_id % 20 AS case_id, text FROM {documents}"
PHRASES = "SELECT item_id % 20 AS case_id, text AS phrase FROM {benchmark}"


@query("forbidden_phrases", f"SELECT id, phrase FROM ({REPORTS}) JOIN ({PHRASES}) USING (case_id) WHERE contains(text, phrase)")
def forbidden_phrases(spark, sf_dir):
    return g.forbidden_phrases(rows(spark, sf_dir, REPORTS), rows(spark, sf_dir, PHRASES))
