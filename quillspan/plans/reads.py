"""Queries of reads over persisted tables."""

from __future__ import annotations

from quillspan.operators import runs as u
from quillspan.plans.registry import query, rows

OBS = "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS doc_id, l_shipdate AS created_at FROM {lineitem}"
OWNERS = "SELECT o_orderkey AS doc_id, o_custkey AS project FROM {orders}"


@query("observations_by_project", f"SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY created_at, id) AS INT) AS pos, id, doc_id FROM (SELECT DISTINCT * FROM ({OBS})) JOIN ({OWNERS}) USING (doc_id)")
def observations_by_project(spark, sf_dir):
    return u.observations_by_project(rows(spark, sf_dir, OBS).distinct(), rows(spark, sf_dir, OWNERS))


PATTERNS = "SELECT o_orderkey AS id, o_custkey AS project, CASE WHEN o_orderstatus = 'P' THEN 'deviation' ELSE 'repetition' END AS kind, o_orderdate AS created_at FROM {orders}"
LINKS = "SELECT DISTINCT l_orderkey AS id, l_partkey AS observation_id FROM {lineitem}"


@query("patterns_ranked", f"WITH o AS (SELECT id, string_agg(CAST(observation_id AS VARCHAR), ',' ORDER BY observation_id) AS observations FROM ({LINKS}) GROUP BY 1) SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY kind <> 'deviation', created_at, id) AS INT) AS pos, id, kind, coalesce(observations, '') AS observations FROM ({PATTERNS}) LEFT JOIN o USING (id)")
def patterns_ranked(spark, sf_dir):
    return u.patterns_ranked(rows(spark, sf_dir, PATTERNS), rows(spark, sf_dir, LINKS))


FINDINGS = "SELECT s_suppkey AS finding_id, s_nationkey AS project FROM {supplier}"
USED = "SELECT DISTINCT l_suppkey AS finding_id, l_orderkey AS id FROM {lineitem} WHERE l_linenumber = 1"


@query("patterns_of_finding", f"SELECT finding_id, id, kind FROM ({FINDINGS}) JOIN ({USED}) USING (finding_id) JOIN ({PATTERNS}) USING (id)")
def patterns_of_finding(spark, sf_dir):
    return u.patterns_of_finding(rows(spark, sf_dir, FINDINGS), rows(spark, sf_dir, USED), rows(spark, sf_dir, PATTERNS))


@query("evidence_count_by_project", f"SELECT project, count(*) AS evidence FROM ({USED}) JOIN ({FINDINGS}) USING (finding_id) GROUP BY 1")
def evidence_count_by_project(spark, sf_dir):
    return u.evidence_count_by_project(rows(spark, sf_dir, USED), rows(spark, sf_dir, FINDINGS))


RELEVANT = "SELECT l_suppkey AS finding_id, l_orderkey * 10 + l_linenumber AS id, max(l_discount) AS relevance FROM {lineitem} GROUP BY 1, 2"


@query("evidence_ranked", f"SELECT finding_id, CAST(row_number() OVER (PARTITION BY finding_id ORDER BY relevance DESC, id) AS INT) AS rank, id, relevance FROM ({RELEVANT})")
def evidence_ranked(spark, sf_dir):
    return u.evidence_ranked(rows(spark, sf_dir, RELEVANT))


OWNED = "SELECT l_orderkey AS id, l_returnflag AS run FROM {lineitem} UNION ALL SELECT -l_suppkey, l_linestatus FROM {lineitem}"


@query("backfill_observation_run", f"SELECT id, min(run) AS run FROM ({OWNED}) GROUP BY 1 HAVING count(DISTINCT run) = 1")
def backfill_observation_run(spark, sf_dir):
    return u.backfill_observation_run(rows(spark, sf_dir, OWNED))
