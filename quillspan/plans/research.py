"""Queries of gaps, hypotheses, claims and scenarios; their tables are derived from orders by rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import research as r
from quillspan.plans.registry import query, rows

NEED = """CASE o_orderkey % 9 WHEN 0 THEN 'A Control  Group' WHEN 1 THEN 'a control group' WHEN 2 THEN 'policy date' WHEN 3 THEN 'Population by region' WHEN 4 THEN 'definition of sales' WHEN 5 THEN 'provenance' WHEN 6 THEN 'macro data' WHEN 7 THEN 'baseline trend' ELSE 'something' END"""
GAPS = f"SELECT o_custkey % 40 AS run, CAST(year(o_orderdate) - 1994 AS INT) AS seq, o_orderkey AS gap_id, {NEED} AS need, CAST(o_orderkey % 6 AS STRING) AS hypothesis, o_orderkey % 4 <> 0 AS resolvable, o_orderkey % 3 = 0 AS resolved FROM {{orders}}"
CATEGORY = "CASE need WHEN 'A Control  Group' THEN 'OTHER' WHEN 'a control group' THEN 'COMPARISON' WHEN 'policy date' THEN 'TIMING' WHEN 'Population by region' THEN 'CONFOUNDER' WHEN 'definition of sales' THEN 'MEASUREMENT' WHEN 'provenance' THEN 'SOURCE_QUALITY' WHEN 'macro data' THEN 'EXTERNAL_CONTEXT' WHEN 'baseline trend' THEN 'PRE_PERIOD' ELSE 'OTHER' END"
STATUS = "CASE (o_orderkey + o_custkey) % 6 WHEN 0 THEN 'CONTRADICTED' WHEN 1 THEN 'INSUFFICIENT_EVIDENCE' WHEN 2 THEN 'UNTESTED' WHEN 3 THEN 'PARTIALLY_SUPPORTED' WHEN 4 THEN 'PLAUSIBLE' ELSE 'SUPPORTED' END"
STATES = f"SELECT o_custkey % 40 AS run, CAST(year(o_orderdate) - 1994 AS INT) AS seq, concat(CASE WHEN o_orderkey % 2 = 0 THEN 'Hyp  ' ELSE 'hyp ' END, CAST(o_custkey % 7 AS STRING)) AS title, {STATUS} AS status FROM {{orders}}"
RANK = "CASE status WHEN 'CONTRADICTED' THEN -1 WHEN 'UNTESTED' THEN 0 WHEN 'INSUFFICIENT_EVIDENCE' THEN 1 WHEN 'PLAUSIBLE' THEN 2 WHEN 'PARTIALLY_SUPPORTED' THEN 3 ELSE 4 END"
BY_RUN = f"SELECT o_custkey % 40 AS run, CAST(o_orderkey % 6 AS STRING) AS hypothesis, bool_or(o_orderstatus = 'F') AS identified, min({STATUS}) AS validation FROM {{orders}} GROUP BY 1, 2"


@query("classify_gaps", f"SELECT gap_id, need, {CATEGORY} AS category FROM ({GAPS})")
def classify_gaps(spark, sf_dir):
    return r.classify_gaps(rows(spark, sf_dir, GAPS)).select("gap_id", "need", "category")


@query("collect_gaps", f"SELECT run, seq, trim(regexp_replace(lower(need), '\\s+', ' ', 'g')) AS need_key, string_agg(DISTINCT hypothesis, ',' ORDER BY hypothesis) AS hypotheses, count(DISTINCT hypothesis) AS n_hypotheses FROM ({GAPS}) GROUP BY 1, 2, 3")
def collect_gaps(spark, sf_dir):
    return r.collect_gaps(rows(spark, sf_dir, GAPS))


@query("plan_requirements", f"SELECT gap_id, need, category, dimensions, period, source_category FROM (SELECT gap_id, need, {CATEGORY} AS category FROM ({GAPS})) JOIN (VALUES {', '.join(map(str, r.REQUIREMENTS))}) t(category, dimensions, period, source_category) USING (category)")
def plan_requirements(spark, sf_dir):
    return r.plan_requirements(rows(spark, sf_dir, GAPS))


@query("gap_dependencies", f"WITH g AS (SELECT *, {CATEGORY} AS category FROM ({GAPS})) SELECT a.run, a.gap_id, string_agg(DISTINCT lpad(CAST(b.gap_id AS VARCHAR), 8, '0'), ',' ORDER BY lpad(CAST(b.gap_id AS VARCHAR), 8, '0')) AS depends_on FROM g a JOIN g b ON a.run = b.run AND a.hypothesis = b.hypothesis AND a.gap_id <> b.gap_id WHERE a.category IN ('COMPARISON', 'PRE_PERIOD', 'CONFOUNDER', 'EXTERNAL_CONTEXT') AND b.category IN ('MEASUREMENT', 'SOURCE_QUALITY') AND NOT b.resolved GROUP BY 1, 2")
def gap_dependencies(spark, sf_dir):
    return r.gap_dependencies(r.classify_gaps(rows(spark, sf_dir, GAPS)))


@query("rank_requirements", f"""WITH g AS (SELECT *, {CATEGORY} AS category FROM ({GAPS})), f AS (SELECT g.run, gap_id, need, category, resolvable, count(DISTINCT g.hypothesis) AS h, bool_or(NOT identified) AS un, bool_or(validation IN ('UNTESTED', 'INSUFFICIENT_EVIDENCE')) AS ut FROM g LEFT JOIN ({BY_RUN}) s ON s.run = g.run AND s.hypothesis = g.hypothesis GROUP BY ALL),
p AS (SELECT *, CASE WHEN category IN ('COMPARISON', 'PRE_PERIOD', 'CONFOUNDER') THEN 3 WHEN category IN ('TIMING', 'MEASUREMENT') THEN 2 ELSE 1 END AS power, CASE WHEN NOT resolvable THEN 4 WHEN category IN ('TIMING', 'MEASUREMENT', 'SOURCE_QUALITY') THEN 0 WHEN category IN ('PRE_PERIOD', 'CONFOUNDER', 'EXTERNAL_CONTEXT') THEN 1 WHEN category = 'COMPARISON' THEN 2 ELSE 3 END AS difficulty FROM f),
w AS (SELECT a.run, a.gap_id, count(DISTINCT b.gap_id) AS waits FROM g a JOIN g b ON a.run = b.run AND a.hypothesis = b.hypothesis AND a.gap_id <> b.gap_id WHERE a.category IN ('COMPARISON', 'PRE_PERIOD', 'CONFOUNDER', 'EXTERNAL_CONTEXT') AND b.category IN ('MEASUREMENT', 'SOURCE_QUALITY') AND NOT b.resolved GROUP BY 1, 2),
u AS (SELECT *, CASE WHEN power = 3 AND un THEN 3 WHEN power = 2 OR ut THEN 2 ELSE 1 END AS urgency FROM p)
SELECT run, gap_id, power, urgency, difficulty, h >= 2 AS can_distinguish, h >= 1 AND category <> 'OTHER' AS can_falsify, CAST(row_number() OVER (PARTITION BY run ORDER BY power DESC, urgency DESC, waits, difficulty, need, gap_id) AS INT) AS rank FROM (SELECT u.*, coalesce(w.waits, 0) AS waits FROM u LEFT JOIN w ON w.run = u.run AND w.gap_id = u.gap_id)""")
def rank_requirements(spark, sf_dir):
    return r.rank_requirements(r.classify_gaps(rows(spark, sf_dir, GAPS)), rows(spark, sf_dir, BY_RUN))


SEEN = f"SELECT DISTINCT run, seq, lower(need) AS need_key FROM ({GAPS}) WHERE gap_id % 5 = run % 5"
ITERATIONS = "SELECT DISTINCT o_custkey % 40 AS run, CAST(year(o_orderdate) - 1994 AS INT) AS seq FROM {orders}"
FOUND = f"SELECT o_custkey % 40 AS run, CAST(year(o_orderdate) - 1994 AS INT) AS seq, CASE WHEN year(o_orderdate) % 2 = 0 THEN lower({NEED}) END AS need_key FROM {{orders}} WHERE o_orderstatus = 'P'"
CARRIED = f"""WITH seen AS ({SEEN}), it AS ({ITERATIONS}), ev AS ({FOUND}), f AS (SELECT run, need_key, min(seq) AS first FROM seen GROUP BY 1, 2), e AS (SELECT f.run, f.need_key, it.seq FROM f JOIN it ON it.run = f.run AND it.seq >= f.first),
loose AS (SELECT run, seq, count(need_key) = 0 AS loose FROM ev GROUP BY 1, 2),
m AS (SELECT e.*, s.run IS NOT NULL AS here, CASE WHEN s.run IS NOT NULL THEN 'OPEN' WHEN coalesce(CASE WHEN a.run IS NOT NULL THEN true END, l.loose, false) THEN 'RESOLVED' END AS event FROM e LEFT JOIN seen s USING (run, need_key, seq) LEFT JOIN (SELECT DISTINCT run, need_key, seq FROM ev WHERE need_key IS NOT NULL) a USING (run, need_key, seq) LEFT JOIN loose l ON l.run = e.run AND l.seq = e.seq),
st AS (SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY run, need_key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM m),
carried AS (SELECT run, need_key, seq, CASE WHEN s = 'OPEN' AND NOT here THEN 'CARRIED' ELSE s END AS state FROM st)
"""


def _carried(spark, sf_dir):
    return r.carry_forward_gaps(rows(spark, sf_dir, SEEN), rows(spark, sf_dir, ITERATIONS), rows(spark, sf_dir, FOUND))


@query("carry_forward_gaps", CARRIED + "SELECT * FROM carried")
def carry_forward_gaps(spark, sf_dir):
    return _carried(spark, sf_dir)


ONE = f"SELECT run, seq, title, status FROM ({STATES}) QUALIFY row_number() OVER (PARTITION BY run, seq, lower(title) ORDER BY status) = 1"
EVOLVED = f""", hs AS ({STATES}), hk AS (SELECT run, seq, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS key, max({RANK}) AS k FROM hs GROUP BY 1, 2, 3), hb AS (SELECT hk.run, hk.key, hk.seq, hk.k, p.k AS pk FROM hk LEFT JOIN hk p ON p.run = hk.run AND p.key = hk.key AND p.seq = hk.seq - 1),
changed AS (SELECT run, key, seq, k, CASE WHEN pk IS NULL THEN 'CREATED' WHEN k = pk THEN 'UNCHANGED' WHEN k = -1 THEN 'CONTRADICTED' WHEN k > greatest(pk, 0) THEN 'STRENGTHENED' ELSE 'WEAKENED' END AS change FROM hb)
"""


@query("hypothesis_evolution", "WITH x AS (SELECT 1)" + EVOLVED + "SELECT run, key, seq, change FROM changed")
def hypothesis_evolution(spark, sf_dir):
    return r.hypothesis_evolution(rows(spark, sf_dir, STATES)).select("run", "key", "seq", "change")


LISTS = "SELECT o_custkey % 40 AS run, CAST(year(o_orderdate) - 1994 AS INT) AS seq, o_orderstatus AS kind, o_orderpriority AS member FROM {orders}"


@query("iteration_delta", f"WITH l AS (SELECT run, seq, kind, list(DISTINCT member) AS now FROM ({LISTS}) GROUP BY 1, 2, 3) SELECT a.run, a.kind, a.seq, coalesce(array_to_string(list_sort(list_filter(a.now, lambda m: NOT list_contains(b.now, m))), ','), '') AS added, coalesce(array_to_string(list_sort(list_filter(b.now, lambda m: NOT list_contains(a.now, m))), ','), '') AS removed FROM l a JOIN l b ON b.run = a.run AND b.kind = a.kind AND b.seq = a.seq - 1")
def iteration_delta(spark, sf_dir):
    return r.iteration_delta(rows(spark, sf_dir, LISTS))


SUMMARY = f"SELECT run, seq, count(*) FILTER (status <> 'CONTRADICTED') AS surviving, count(*) FILTER (status IN ('PARTIALLY_SUPPORTED', 'SUPPORTED')) AS supported, count(*) FILTER (status = 'SUPPORTED') AS strong, count(*) FILTER (status = 'CONTRADICTED') AS contradicted, split_part(min(CAST(9 - {RANK} AS VARCHAR) || '~' || title) FILTER (status <> 'CONTRADICTED'), '~', 2) AS strongest FROM ({STATES}) GROUP BY 1, 2"


@query("hypothesis_summary", SUMMARY)
def hypothesis_summary(spark, sf_dir):
    return r.hypothesis_summary(rows(spark, sf_dir, STATES))


FACTS = "SELECT c_custkey AS run, CAST(c_custkey % 4 AS INT) AS iterations, CAST(c_custkey % 3 AS INT) AS hypotheses, CAST(c_custkey % 5 AS INT) AS open_gaps, CAST(c_custkey % 2 AS INT) AS resolvable_gaps, CAST(floor(c_custkey / 5) % 3 AS INT) AS supported, CAST(floor(c_custkey / 7) % 2 AS INT) AS strong, CAST(floor(c_custkey / 11) % 3 AS INT) AS evidence, CAST(floor(c_custkey / 13) % 2 AS INT) AS high_open, c_acctbal > 5000 AS moved, c_acctbal > 2000 AS unidentified FROM {customer}"
READY = f"SELECT *, CASE WHEN iterations = 0 OR hypotheses = 0 THEN 'EVIDENCE_INSUFFICIENT' WHEN open_gaps > 0 AND resolvable_gaps = 0 THEN 'BLOCKED' WHEN supported = 0 THEN 'EVIDENCE_INSUFFICIENT' WHEN iterations = 1 OR evidence = 0 THEN 'EXPLORATORY_ONLY' WHEN high_open > 0 THEN CASE WHEN supported = 1 AND strong = 1 THEN 'EVIDENCE_CONVERGING' ELSE 'VALIDATION_REQUIRED' END WHEN supported = 1 AND strong = 1 THEN 'DECISION_READY_WITH_LIMITATIONS' WHEN supported = 1 THEN 'EVIDENCE_CONVERGING' WHEN NOT moved THEN 'INCONCLUSIVE' ELSE 'EVIDENCE_CONVERGING' END AS state FROM ({FACTS})"


@query("decision_readiness", f"SELECT run, state FROM ({READY})")
def decision_readiness(spark, sf_dir):
    return r.decision_readiness(rows(spark, sf_dir, FACTS)).select("run", "state")


@query("stop_reason", f"SELECT run, CASE WHEN state = 'DECISION_READY_WITH_LIMITATIONS' THEN 'HYPOTHESES_DISTINGUISHED' WHEN state = 'BLOCKED' THEN 'NO_FEASIBLE_DATA_SOURCE' WHEN state = 'INCONCLUSIVE' AND open_gaps = 0 AND unidentified THEN 'IDENTIFICATION_UNRESOLVED' WHEN state = 'INCONCLUSIVE' THEN 'CONFLICTING_EVIDENCE_REMAINS' END AS reason FROM ({READY})")
def stop_reason(spark, sf_dir):
    return r.stop_reason(r.decision_readiness(rows(spark, sf_dir, FACTS)))


@query("open_gap_handoff", CARRIED[:-1] + EVOLVED + """, la AS (SELECT run, max(seq) AS seq FROM carried GROUP BY 1) SELECT la.run, la.seq, (SELECT count(*) FROM carried c WHERE c.run = la.run AND c.seq = la.seq AND state <> 'RESOLVED') AS open_gaps,
  coalesce((SELECT string_agg(DISTINCT key, ',' ORDER BY key) FROM changed c WHERE c.run = la.run AND c.seq = la.seq AND change IN ('WEAKENED', 'CONTRADICTED')), '') AS weakened, (SELECT count(*) FROM ev WHERE ev.run = la.run) AS evidence_added FROM la""")
def open_gap_handoff(spark, sf_dir):
    return r.open_gap_handoff(_carried(spark, sf_dir), r.hypothesis_evolution(rows(spark, sf_dir, STATES)), rows(spark, sf_dir, FOUND))


REFS = "SELECT conv_id AS claim_id, CASE WHEN turn % 4 = 0 THEN concat(' ', CAST(conv_id * 7 AS STRING)) WHEN turn % 4 = 1 THEN concat('ext', CAST(conv_id % 30 AS STRING)) WHEN turn % 4 = 2 AND conv_id % 2 = 0 THEN 'none' WHEN turn % 4 = 2 THEN ' ' ELSE CAST(conv_id + 100000 AS STRING) END AS ref FROM {conversations}"
OBSERVED = "SELECT event_id + 100000 AS id FROM {events} WHERE event_id % 3 = 0"
EXT = "SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN concat('ext', CAST(doc_id % 40 AS STRING)) END AS ext FROM {documents}"
CITES = f"""WITH refs AS (SELECT claim_id, trim(ref) AS ref FROM ({REFS}) WHERE trim(ref) <> ''), obs AS ({OBSERVED}), ext AS ({EXT}), fx AS (SELECT ext AS ref, min(id) AS e FROM ext WHERE ext IS NOT NULL GROUP BY 1),
cites AS (SELECT claim_id, ref, CASE WHEN o.id IS NOT NULL THEN 'OBSERVATION' WHEN coalesce(d.id, e) IS NOT NULL THEN 'DOCUMENT' ELSE 'NOT_FOUND' END AS kind, CASE WHEN o.id IS NULL THEN coalesce(d.id, e) END AS doc_id, CASE WHEN o.id IS NOT NULL THEN ref END AS observation_id FROM refs LEFT JOIN obs o ON CAST(o.id AS VARCHAR) = ref LEFT JOIN ext d ON CAST(d.id AS VARCHAR) = ref LEFT JOIN fx USING (ref))
"""


def _cites(spark, sf_dir):
    return r.claim_citations(rows(spark, sf_dir, REFS), rows(spark, sf_dir, OBSERVED), rows(spark, sf_dir, EXT))


@query("claim_citations", CITES + "SELECT * FROM cites")
def claim_citations(spark, sf_dir):
    return _cites(spark, sf_dir)


CLAIMS = "SELECT conv_id AS claim_id, CASE conv_id % 5 WHEN 0 THEN 'Prices rose because of taxes' WHEN 1 THEN 'It always happens' WHEN 2 THEN 'Sales led to growth for everyone' WHEN 3 THEN '  Sales  LED to growth for everyone' ELSE 'Plain' END AS statement, conv_id % 2 = 0 AS identified FROM {conversations} WHERE turn = 0"
NAMED = "SELECT conv_id AS claim_id, CAST(conv_id % 9 AS STRING) AS hypothesis FROM {conversations} WHERE turn = 0 AND conv_id % 3 = 0"
EVIDENCE = "SELECT CAST(doc_id % 9 AS STRING) AS hypothesis, doc_id, CAST(doc_id + 100000 AS STRING) AS observation_id, CASE doc_id % 4 WHEN 0 THEN 'counter' WHEN 1 THEN 'neutral' ELSE 'support' END AS type FROM {documents}"
BASIS = CITES[:-1] + f""", cl AS ({CLAIMS}), nm AS ({NAMED}), ev AS ({EVIDENCE}), bc AS (SELECT DISTINCT claim_id, hypothesis FROM cites c JOIN ev ON c.doc_id = ev.doc_id OR c.observation_id = ev.observation_id), ba AS (SELECT DISTINCT claim_id, hypothesis FROM nm UNION ALL SELECT * FROM bc WHERE claim_id IN (SELECT claim_id FROM cl) AND claim_id NOT IN (SELECT claim_id FROM nm)),
basis AS (SELECT *, 'BASIS' AS role FROM ba UNION ALL SELECT *, 'COMPETING' FROM (SELECT * FROM bc EXCEPT SELECT * FROM ba))
"""


def _basis(spark, sf_dir):
    return r.claim_basis(rows(spark, sf_dir, CLAIMS), rows(spark, sf_dir, NAMED), _cites(spark, sf_dir), rows(spark, sf_dir, EVIDENCE))


@query("claim_basis", BASIS + "SELECT * FROM basis")
def claim_basis(spark, sf_dir):
    return _basis(spark, sf_dir)


@query("claim_evidence", BASIS + "SELECT b.claim_id, count(*) FILTER (type = 'support') AS support, count(*) FILTER (type = 'counter') AS counter, count(*) FILTER (type = 'neutral') AS neutral FROM basis b JOIN ev USING (hypothesis) WHERE role = 'BASIS' AND EXISTS (SELECT 1 FROM cites c WHERE c.claim_id = b.claim_id AND (c.doc_id = ev.doc_id OR c.observation_id = ev.observation_id)) GROUP BY 1")
def claim_evidence(spark, sf_dir):
    return r.claim_evidence(_basis(spark, sf_dir), _cites(spark, sf_dir), rows(spark, sf_dir, EVIDENCE))


HYP = "SELECT CAST(n_nationkey AS STRING) AS hypothesis, CASE n_nationkey WHEN 0 THEN 'CONTRADICTED' WHEN 1 THEN 'PLAUSIBLE' WHEN 4 THEN 'CONTRADICTED' WHEN 6 THEN 'PARTIALLY_SUPPORTED' WHEN 7 THEN 'UNTESTED' ELSE 'SUPPORTED' END AS status FROM {nation} WHERE n_nationkey < 8"
ABOUT = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'USD' ELSE ' ' END AS unit, CASE WHEN doc_id % 7 = 0 THEN 'all' ELSE 'adults' END AS population, 'year' AS granularity, CAST(NULL AS STRING) AS schema_version FROM {documents}"
FLAGGED = f"""n AS (SELECT claim_id, count(*) FILTER (kind = 'NOT_FOUND') AS lost FROM cites GROUP BY 1), mx AS (SELECT claim_id, count(DISTINCT nullif(trim(unit), '')) > 1 OR count(DISTINCT population) > 1 AS mixed FROM cites JOIN ({ABOUT}) USING (doc_id) GROUP BY 1), lh AS (SELECT DISTINCT claim_id FROM ({NAMED}) WHERE hypothesis NOT IN (SELECT hypothesis FROM ({HYP}))),
flagged AS (SELECT claim_id, concat_ws(',', CASE WHEN n.claim_id IS NULL THEN 'NO_SOURCE_CITATION' END, CASE WHEN lost > 0 THEN 'CITATION_NOT_FOUND' END, CASE WHEN claim_id IN (SELECT claim_id FROM lh) THEN 'HYPOTHESIS_NOT_FOUND' END, CASE WHEN claim_id % 5 IN (0, 2, 3) AND NOT identified THEN 'CAUSAL_LANGUAGE_WITHOUT_IDENTIFICATION' END, CASE WHEN claim_id % 5 IN (1, 2, 3) THEN 'OVERGENERALIZATION_LANGUAGE' END, CASE WHEN mixed THEN 'DEFINITION_OR_POPULATION_MISMATCH' END) AS flags FROM ({CLAIMS}) LEFT JOIN n USING (claim_id) LEFT JOIN mx USING (claim_id))
"""


def _flags(spark, sf_dir):
    return r.claim_flags(rows(spark, sf_dir, CLAIMS), _cites(spark, sf_dir), rows(spark, sf_dir, ABOUT), rows(spark, sf_dir, NAMED), rows(spark, sf_dir, HYP))


@query("claim_flags", CITES[:-1] + f", {FLAGGED} SELECT * FROM flagged")
def claim_flags(spark, sf_dir):
    return _flags(spark, sf_dir)


@query("claim_status", BASIS[:-1] + f""", {FLAGGED}, evd AS (SELECT b.claim_id, count(*) AS cited FROM basis b JOIN ev USING (hypothesis) WHERE role = 'BASIS' AND EXISTS (SELECT 1 FROM cites c WHERE c.claim_id = b.claim_id AND (c.doc_id = ev.doc_id OR c.observation_id = ev.observation_id)) GROUP BY 1),
f AS (SELECT claim_id, count(*) FILTER (role = 'BASIS' AND status IN ('PARTIALLY_SUPPORTED', 'SUPPORTED')) AS good, count(*) FILTER (role = 'BASIS' AND status = 'CONTRADICTED') AS against, count(status) FILTER (role = 'BASIS') AS known, count(*) FILTER (role <> 'BASIS' AND status <> 'CONTRADICTED') AS open FROM basis LEFT JOIN ({HYP}) h USING (hypothesis) GROUP BY 1)
SELECT claim_id, CASE WHEN known = 0 THEN 'UNKNOWN' WHEN against = known THEN 'CONTRADICTED' WHEN good > 0 AND against > 0 THEN 'INSUFFICIENT' WHEN good < known THEN 'INSUFFICIENT' WHEN open > 0 THEN 'INSUFFICIENT' WHEN contains(coalesce(flags, ''), 'CAUSAL_LANGUAGE') THEN 'INSUFFICIENT' WHEN cited IS NULL THEN 'INSUFFICIENT' ELSE 'SUPPORTED' END AS status,
CASE WHEN good > 0 AND against > 0 THEN 'CONFLICTING_EVIDENCE' WHEN known > 0 AND good = known AND open > 0 THEN 'COMPETING_EXPLANATION_OPEN' END AS flag FROM f LEFT JOIN flagged USING (claim_id) LEFT JOIN evd USING (claim_id)""")
def claim_status(spark, sf_dir):
    basis, cites = _basis(spark, sf_dir), _cites(spark, sf_dir)
    return r.claim_status(basis, rows(spark, sf_dir, HYP), _flags(spark, sf_dir), r.claim_evidence(basis, cites, rows(spark, sf_dir, EVIDENCE)))


REPEATED = CLAIMS.replace("SELECT conv_id AS claim_id", "SELECT conv_id % 60 AS claim_id")


@query("claim_duplicates", f"WITH k AS (SELECT DISTINCT claim_id, sha256(trim(regexp_replace(lower(statement), '\\s+', ' ', 'g'))) AS hash FROM ({REPEATED})) SELECT claim_id, hash, nullif(min(claim_id) OVER (PARTITION BY hash), claim_id) AS duplicate_of, CASE WHEN count(*) OVER (PARTITION BY claim_id) > 1 THEN 'CONFLICTING_CONTENT' END AS error FROM k")
def claim_duplicates(spark, sf_dir):
    return r.claim_duplicates(rows(spark, sf_dir, REPEATED))


ORIGIN = "CASE o_orderkey % 8 WHEN 0 THEN 'PRIOR' WHEN 1 THEN 'HUMAN_POST_HOC' WHEN 2 THEN 'LITERATURE' WHEN 3 THEN 'odd' WHEN 4 THEN NULL WHEN 5 THEN 'MODEL_PROPOSED' WHEN 6 THEN 'OTHER' ELSE 'DOMAIN_KNOWLEDGE' END"
EXPECTED = f"SELECT o_orderkey AS id, {ORIGIN} AS basis, CASE WHEN o_orderkey % 9 = 0 THEN 'ROBOT' ELSE 'MODEL' END AS author, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END AS created_at, CAST(o_orderkey % 3 AS INT) AS sources, CASE WHEN o_custkey % 2 = 0 THEN ' ' ELSE 'why' END AS justification, o_orderstatus = 'F' AS data_seen, o_custkey % 3 = 0 AS frozen, CAST(o_orderkey % 4 AS INT) AS criteria, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'x' END AS text FROM {{orders}}"
BROKEN = {"STATEMENT_REQUIRED": "trim(text) = ''", "UNKNOWN_BASIS": "basis = 'odd'", "UNKNOWN_AUTHOR": "author = 'ROBOT'", "CREATED_AT_REQUIRED": "created_at IS NULL", "SOURCE_REQUIRED": "basis IN ('LITERATURE', 'DOMAIN_KNOWLEDGE') AND sources = 0 AND trim(justification) = ''", "PRIOR_AFTER_OBSERVATION": "basis IN ('PRIOR', 'LITERATURE', 'DOMAIN_KNOWLEDGE') AND data_seen", "POST_HOC_WITHOUT_OBSERVATION": "basis IN ('HUMAN_POST_HOC', 'MODEL_PROPOSED') AND NOT data_seen", "CRITERIA_REQUIRED": "frozen AND criteria = 0"}


@query("expectation_checks", f"WITH e AS ({EXPECTED}) " + " UNION ALL ".join(f"SELECT id, '{k}' AS code FROM e WHERE {v}" for k, v in BROKEN.items()))
def expectation_checks(spark, sf_dir):
    return r.expectation_checks(rows(spark, sf_dir, EXPECTED))


SCENARIOS = "SELECT c_custkey AS scenario_id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END AS title, DATE '1998-06-01' AS as_of, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 'decade' END AS horizon, CASE WHEN c_custkey % 7 = 0 THEN DATE '1998-06-01' ELSE DATE '2008-01-01' END AS horizon_end, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 5000 END AS probability, 'survey' AS probability_basis, CAST(c_custkey % 2 AS INT) AS probability_sources, c_custkey % 40 AS run, CAST(c_custkey % 6 AS STRING) AS hypothesis, c_custkey AS doc_id FROM {customer}"
ASSUMED = "SELECT s_nationkey * 7 + 1 AS scenario_id, s_suppkey AS assumption_id, CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE s_name END AS statement, CASE s_suppkey % 3 WHEN 0 THEN 'OBSERVED_BASELINE' WHEN 1 THEN 'POLICY_ASSUMPTION' ELSE 'GUESS' END AS kind, DATE '1998-01-01' AS as_of, CAST(s_suppkey % 2 AS INT) AS evidence FROM {supplier}"
WINDOWS = f"SELECT o_orderkey AS expectation_id, o_custkey AS scenario_id, CASE WHEN o_orderkey % 15 = 0 THEN '' ELSE o_orderpriority END AS indicator, 'says' AS statement, CASE WHEN o_orderkey % 16 = 0 THEN NULL ELSE 'if not' END AS condition, CASE o_orderkey % 6 WHEN 0 THEN 'UP' WHEN 1 THEN 'RANGE' WHEN 2 THEN NULL ELSE 'INCREASE' END AS direction, CASE WHEN o_custkey % 2 = 0 THEN 1.5 END AS low, CAST(NULL AS DOUBLE) AS high, {ORIGIN} AS basis, CAST(o_orderkey % 3 AS INT) AS sources, o_orderstatus = 'F' AS data_seen, CAST(o_orderdate AS DATE) AS window_start, CAST(o_orderdate + CASE WHEN o_orderkey % 12 = 0 THEN INTERVAL '-5' DAY ELSE INTERVAL '60' DAY END AS DATE) AS window_end, DATE '1996-06-01' AS frozen_at FROM {{orders}}"
RELATED = "SELECT c_custkey AS scenario_id, CASE WHEN c_custkey % 4 = 0 THEN 'FRIENDS' ELSE 'NESTED' END AS kind, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE array(c_custkey + 1, c_custkey * 2) END AS others FROM {customer}"
SIGNALS = "SELECT l_orderkey AS expectation_id, CASE l_returnflag WHEN 'A' THEN 'CONSISTENT' WHEN 'R' THEN 'CONTRADICTS' ELSE CASE WHEN l_orderkey % 2 = 0 THEN 'INCONCLUSIVE' ELSE 'NOT_OBSERVED' END END AS outcome, CAST(l_shipdate AS DATE) AS observed_at FROM {lineitem} WHERE l_linenumber = 1 AND l_partkey % 4 > 0"
HELD_BY = "SELECT DISTINCT o_custkey AS scenario_id, o_orderpriority AS assumption_id FROM {orders} WHERE o_orderpriority <> '5-LOW'"
CHECKS = "SELECT o_custkey AS scenario_id, o_orderpriority AS assumption_id, CASE o_orderstatus WHEN 'P' THEN 'INVALIDATED' WHEN 'F' THEN 'HOLDS' ELSE 'UNKNOWN' END AS result, o_orderkey AS n FROM {orders}"
STATUSES = f"""WITH x AS ({WINDOWS}), o AS ({SIGNALS}), k AS (SELECT DISTINCT scenario_id FROM (SELECT scenario_id, assumption_id, arg_max(result, n) AS c FROM ({CHECKS}) GROUP BY 1, 2) WHERE c = 'INVALIDATED' AND assumption_id <> '5-LOW'),
y AS (SELECT scenario_id, expectation_id, outcome, observed_at >= window_start AND observed_at <= window_end AND observed_at > frozen_at AS inside FROM x LEFT JOIN o USING (expectation_id)),
f AS (SELECT scenario_id, count(*) FILTER (inside AND outcome = 'CONTRADICTS') AS against, count(*) FILTER (inside AND outcome = 'CONSISTENT') AS fits, count(*) FILTER (outcome = 'INCONCLUSIVE' OR outcome IN ('CONTRADICTS', 'CONSISTENT') AND NOT inside) AS n FROM y GROUP BY 1),
st AS (SELECT f.scenario_id, CASE WHEN against > 0 THEN 'CONTRADICTED' WHEN k.scenario_id IS NOT NULL THEN 'WEAKENED' WHEN fits > 0 THEN 'CONSISTENT_SO_FAR' WHEN n > 0 THEN 'INCONCLUSIVE' ELSE 'UNTESTED' END AS status FROM f LEFT JOIN k USING (scenario_id))
"""


def _statuses(spark, sf_dir):
    return r.scenario_status(rows(spark, sf_dir, WINDOWS), rows(spark, sf_dir, SIGNALS), rows(spark, sf_dir, HELD_BY), rows(spark, sf_dir, CHECKS))


BAD_SCENARIO = {"TITLE_REQUIRED": "title = ''", "HORIZON_REQUIRED": "horizon IS NULL", "HORIZON_BEFORE_BASELINE": "horizon_end <= as_of", "PROBABILITY_WITHOUT_BASIS": "probability < 0 OR probability > 1 OR probability IS NOT NULL AND probability_sources = 0", "NO_FUTURE_EXPECTATION": "NOT EXISTS (SELECT 1 FROM x WHERE x.scenario_id = t.scenario_id AND x.window_end > t.as_of)"}
BAD_ASSUMPTION = {"ASSUMPTION_INCOMPLETE": "statement = ' ' OR kind = 'GUESS'", "BASELINE_WITHOUT_EVIDENCE": "kind = 'OBSERVED_BASELINE' AND evidence = 0", "EVIDENCE_FOR_ASSUMPTION": "kind <> 'OBSERVED_BASELINE' AND evidence > 0"}
BAD_EXPECTATION = {"EXPECTATION_INCOMPLETE": "indicator = ''", "CONDITION_REQUIRED": "condition IS NULL", "BAD_WINDOW": "window_end < window_start", "UNKNOWN_DIRECTION": "direction = 'UP'", "RANGE_REQUIRED": "direction = 'RANGE' AND low IS NULL", "UNKNOWN_BASIS": "coalesce(basis, 'odd') = 'odd'", "SOURCE_REQUIRED": "basis IN ('LITERATURE', 'DOMAIN_KNOWLEDGE') AND sources = 0", "POST_HOC_LEAKAGE": "basis IN ('PRIOR', 'LITERATURE', 'DOMAIN_KNOWLEDGE') AND data_seen"}
BAD_RELATION = {"RELATION_TOO_SMALL": "others IS NULL", "UNKNOWN_RELATION": "kind = 'FRIENDS'", "UNKNOWN_SCENARIO": "EXISTS (SELECT 1 FROM (SELECT unnest(t.others) AS o) u WHERE u.o NOT IN (SELECT scenario_id FROM s))"}
BAD = [f"SELECT scenario_id, '{code}' AS code FROM {table} t WHERE {when}" for table, codes in (("s", BAD_SCENARIO), ("a", BAD_ASSUMPTION), ("x", BAD_EXPECTATION), ("rl", BAD_RELATION)) for code, when in codes.items()]


@query("scenario_validate", f"WITH s AS ({SCENARIOS}), a AS ({ASSUMED}), x AS ({WINDOWS}), rl AS ({RELATED.replace('array(', 'list_value(')}) " + " UNION ".join(BAD))
def scenario_validate(spark, sf_dir):
    return r.scenario_validate(rows(spark, sf_dir, SCENARIOS), rows(spark, sf_dir, ASSUMED), rows(spark, sf_dir, WINDOWS), rows(spark, sf_dir, RELATED))


CRITERIA = "SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'CONTRADICTED' ELSE 'PLAUSIBLE' END AS status, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE array(p_brand, p_type) END AS criteria FROM {part}"


@query("scenario_scaffold", f"WITH c AS (SELECT *, CASE WHEN status = 'CONTRADICTED' THEN 'CONTRADICTED' WHEN criteria IS NULL THEN 'NO_CRITERIA' END AS skipped FROM ({CRITERIA.replace('array(', 'list_value(')})) SELECT id, CAST(generate_subscripts(criteria, 1) - 1 AS INT) AS pos, unnest(criteria) AS criterion, skipped FROM c WHERE skipped IS NULL UNION ALL SELECT id, NULL, NULL, skipped FROM c WHERE skipped IS NOT NULL")
def scenario_scaffold(spark, sf_dir):
    return r.scenario_scaffold(rows(spark, sf_dir, CRITERIA))


@query("scenario_status", STATUSES + "SELECT * FROM st")
def scenario_status(spark, sf_dir):
    return _statuses(spark, sf_dir)


@query("scenario_requirements", STATUSES + "SELECT scenario_id, expectation_id FROM x WHERE expectation_id NOT IN (SELECT expectation_id FROM y WHERE inside AND outcome IN ('CONTRADICTS', 'CONSISTENT'))")
def scenario_requirements(spark, sf_dir):
    return r.scenario_requirements(rows(spark, sf_dir, WINDOWS), rows(spark, sf_dir, SIGNALS))


EVALS = "SELECT o_custkey AS scenario_id, o_orderkey AS eval, CASE o_orderstatus WHEN 'O' THEN 'CONSISTENT_SO_FAR' WHEN 'F' THEN 'CONTRADICTED' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'WEAKENED' ELSE 'INCONCLUSIVE' END END AS status FROM {orders}"
NEEDS = "SELECT o_custkey AS scenario_id, o_orderkey AS eval, l_returnflag AS expectation_id FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey"


@query("scenario_delta", f"""WITH e AS (SELECT *, lag(eval) OVER w AS prev, coalesce(lag(status) OVER w, 'UNTESTED') AS before FROM ({EVALS}) WINDOW w AS (PARTITION BY scenario_id ORDER BY eval)), n AS (SELECT DISTINCT * FROM ({NEEDS})),
q AS (SELECT n.scenario_id, n.eval, string_agg(n.expectation_id, ',' ORDER BY n.expectation_id) AS fresh FROM n JOIN e USING (scenario_id, eval) LEFT JOIN n p ON p.scenario_id = e.scenario_id AND p.eval = e.prev AND p.expectation_id = n.expectation_id WHERE p.eval IS NULL GROUP BY 1, 2)
SELECT scenario_id, eval, before, status, CASE WHEN before = status THEN 'UNCHANGED' WHEN status = 'CONTRADICTED' THEN 'CONTRADICTED' WHEN status = 'WEAKENED' THEN 'WEAKENED' WHEN status = 'CONSISTENT_SO_FAR' THEN 'STRENGTHENED' ELSE 'MOVED' END AS change, coalesce(fresh, '') AS newly_required FROM e LEFT JOIN q USING (scenario_id, eval)""")
def scenario_delta(spark, sf_dir):
    return r.scenario_delta(rows(spark, sf_dir, EVALS), rows(spark, sf_dir, NEEDS))


AS_OF = "SELECT o_custkey AS run, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS as_of FROM {orders}"


@query("as_of_monotonic", f"SELECT run, seq, as_of, latest FROM (SELECT *, max(as_of) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM ({AS_OF})) WHERE as_of < latest")
def as_of_monotonic(spark, sf_dir):
    return r.as_of_monotonic(rows(spark, sf_dir, AS_OF))


FINDINGS = "SELECT source AS run, doc_id AS id, CASE WHEN doc_id % 97 = 0 THEN NULL ELSE 'PRIOR' END AS basis FROM {documents}"
TYPED = "SELECT doc_id AS id, doc_id, CASE WHEN doc_id % 50 = 3 THEN 'counter' ELSE 'support' END AS type FROM {documents} WHERE doc_id % 61 > 0"
TURNS = "SELECT source AS run, doc_id AS seq, CAST(doc_id % 3 AS INT) AS gaps, CAST(doc_id % 5 AS INT) AS unresolved FROM {documents}"
RUNS = "SELECT source AS run, CASE WHEN min(doc_id) % 4 = 0 THEN '' ELSE 'VALIDATION' END AS stage, CASE WHEN min(doc_id) % 3 = 0 THEN 'model' ELSE 'deterministic' END AS mode, count(lang) = count(*) AS hashes, CAST(count(text) AS INT) AS grounded, CAST(count(*) AS INT) AS candidates, min(doc_id) % 2 = 0 AS limitations, max(doc_id) % 6 = 0 AS warnings, count(*) > 3 AS rivals_considered, max(doc_id) % 5 > 0 AS status_accurate, true AS readiness_honest FROM {documents} GROUP BY source"
PUBLISHED = f"WITH i AS ({FINDINGS}), e AS ({TYPED}), g AS (SELECT run, bool_and(coalesce(basis, '') <> '') AS all_have_basis, bool_and(e.id IS NOT NULL) AS all_have_evidence, bool_or(coalesce(e.type, '') = 'counter') AS any_counter FROM i LEFT JOIN e USING (id) GROUP BY 1), l AS (SELECT run, arg_max(gaps, seq) > 0 AS gaps_disclosed, arg_max(unresolved, seq) > 0 AS unresolved_disclosed FROM ({TURNS}) GROUP BY 1), facts AS (SELECT u.*, all_have_basis, all_have_evidence, any_counter, gaps_disclosed, unresolved_disclosed FROM ({RUNS}) u LEFT JOIN g USING (run) LEFT JOIN l USING (run))\n"
UNMET = {"source_provenance": "hashes", "deterministic": "mode = 'deterministic'", "grounded": "candidates > 0 AND grounded = candidates", "expectation_provenance": "all_have_basis", "stage": "stage <> ''", "evidence": "all_have_evidence", "counter_evidence": "any_counter", "limitations": "limitations", "gaps": "gaps_disclosed", "unresolved": "unresolved_disclosed", "no_mismatch": "NOT warnings", "rivals_considered": "rivals_considered", "status_accurate": "status_accurate", "readiness_honest": "readiness_honest"}


def _facts(spark, sf_dir):
    return r.publication_facts(rows(spark, sf_dir, FINDINGS), rows(spark, sf_dir, TYPED), rows(spark, sf_dir, TURNS), rows(spark, sf_dir, RUNS))


@query("publication_facts", PUBLISHED + "SELECT * FROM facts")
def publication_facts(spark, sf_dir):
    return _facts(spark, sf_dir)


@query("publication_checklist", PUBLISHED + "SELECT run, unmet, unmet = '' AS ready FROM (SELECT run, concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({v}) THEN '{k}' END" for k, v in UNMET.items()) + ") AS unmet FROM facts)")
def publication_checklist(spark, sf_dir):
    return r.publication_checklist(_facts(spark, sf_dir))


HELD = "SELECT o_custkey % 40 AS run, CAST(year(o_orderdate) - 1994 AS INT) AS seq, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderpriority END AS expectation, o_orderkey % 2 = 0 AS frozen FROM {orders}"


@query("derive_expectations", f"WITH o AS (SELECT run, seq, id, expectation, CAST(NULL AS INT) AS from_seq, frozen FROM ({HELD}) WHERE trim(expectation) <> '') SELECT * FROM o UNION ALL SELECT run, seq + 1, id, expectation, seq, frozen FROM o JOIN (SELECT run, max(seq) AS last FROM o GROUP BY 1) USING (run) WHERE frozen AND seq < last")
def derive_expectations(spark, sf_dir):
    return r.derive_expectations(rows(spark, sf_dir, HELD))


STAGED = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'SYNTHESIS' WHEN 1 THEN 'VALIDATION' ELSE 'EXPLORATORY' END AS stage, CASE o_orderstatus WHEN 'O' THEN 'PRIOR' WHEN 'F' THEN 'LITERATURE' ELSE 'HUMAN_POST_HOC' END AS basis FROM {orders}"


@query("finding_kind", f"SELECT id, CASE WHEN stage = 'SYNTHESIS' THEN 'SYNTHESIS' WHEN stage = 'VALIDATION' AND basis <> 'HUMAN_POST_HOC' THEN 'VALIDATION_RESULT' ELSE 'EXPLORATORY_FINDING' END AS kind FROM ({STAGED})")
def finding_kind(spark, sf_dir):
    return r.finding_kind(rows(spark, sf_dir, STAGED))


PROOF = "SELECT o_orderkey AS id, o_orderkey % 3 AS made_seq, o_custkey % 3 AS used_seq, o_orderstatus = 'F' AS unseen, o_orderkey % 5 > 0 AS frozen FROM {orders}"


@query("independent_evidence", f"SELECT id, why IS NULL AS independent, why AS reason FROM (SELECT id, CASE WHEN NOT frozen THEN 'EXPECTATION_NOT_FROZEN' WHEN made_seq = used_seq AND NOT unseen THEN 'SAME_ITERATION' END AS why FROM ({PROOF}))")
def independent_evidence(spark, sf_dir):
    return r.independent_evidence(rows(spark, sf_dir, PROOF))


TOUCHED = "SELECT o_custkey % 40 AS run, CAST(o_orderkey % 6 AS STRING) AS hypothesis FROM {orders} WHERE o_orderstatus = 'P'"
MOVED = "SELECT o_custkey % 40 AS run, CAST(o_orderkey % 6 AS STRING) AS hypothesis FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"


@query("affected_hypotheses", f"SELECT * FROM ({TOUCHED}) UNION SELECT * FROM ({MOVED})")
def affected_hypotheses(spark, sf_dir):
    return r.affected_hypotheses(rows(spark, sf_dir, TOUCHED), rows(spark, sf_dir, MOVED))


@query("affected_scenarios", f"WITH s AS ({SCENARIOS}), h AS (SELECT * FROM ({TOUCHED}) UNION SELECT * FROM ({MOVED})) SELECT DISTINCT scenario_id FROM s WHERE EXISTS (SELECT 1 FROM h WHERE h.run = s.run AND h.hypothesis = s.hypothesis) OR doc_id IN (SELECT doc_id FROM documents WHERE lang = 'es')")
def affected_scenarios(spark, sf_dir):
    return r.affected_scenarios(rows(spark, sf_dir, SCENARIOS), affected_hypotheses(spark, sf_dir), rows(spark, sf_dir, "SELECT doc_id FROM {documents} WHERE lang = 'es'"))


@query("iteration_scenarios", STATUSES + f"SELECT s.scenario_id, coalesce(st.status, 'UNTESTED') AS status FROM ({SCENARIOS}) s LEFT JOIN st USING (scenario_id)")
def iteration_scenarios(spark, sf_dir):
    return r.iteration_scenarios(rows(spark, sf_dir, SCENARIOS), _statuses(spark, sf_dir))


SPLIT = "SELECT o_custkey AS id, o_orderkey AS doc_id, CASE o_orderstatus WHEN 'O' THEN 'support' WHEN 'F' THEN 'counter' ELSE 'neutral' END AS type FROM {orders}"


@query("finding_evidence_split", f"SELECT id, {', '.join(f'''coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (type = '{k}'), '') AS {k}''' for k in ('support', 'counter', 'neutral'))} FROM ({SPLIT}) GROUP BY 1")
def finding_evidence_split(spark, sf_dir):
    return r.finding_evidence_split(rows(spark, sf_dir, SPLIT))
