"""Queries of passages, grounding and evidence scoring, over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions.values import upper_each
from quillspan.operators import text as x
from quillspan.plans.registry import query, rows

TEXTS = r"SELECT doc_id, source, replace(text, chr(10), concat(chr(10), chr(10))) AS text FROM {documents}"
LIMIT = 400
PASSAGES = f"""WITH d AS ({TEXTS}), b AS (SELECT doc_id, source, generate_subscripts(p, 1) AS block, regexp_replace(unnest(p), '^\\s+|\\s+$', '', 'g') AS piece FROM (SELECT doc_id, source, string_split(text, chr(10) || chr(10)) AS p FROM d)),
c AS (SELECT doc_id, source, block, spot, substring(piece, spot::BIGINT, {LIMIT}) AS passage FROM (SELECT *, unnest(generate_series(1, length(piece), {LIMIT})) AS spot FROM b WHERE piece <> '')),
p AS (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block, spot) - 1 AS INT) AS pos, passage FROM c)
"""


def passages(spark, sf_dir):
    return x.split_passages(rows(spark, sf_dir, TEXTS), LIMIT)


@query("split_passages", PASSAGES + "SELECT doc_id, pos, passage FROM p")
def split_passages(spark, sf_dir):
    return passages(spark, sf_dir)


@query("drop_noise", PASSAGES + r"SELECT doc_id, pos, passage FROM p WHERE regexp_matches(passage, '[\p{L}\p{N}]')")
def drop_noise(spark, sf_dir):
    return x.drop_noise(passages(spark, sf_dir))


@query("dedupe_passages", PASSAGES + r"SELECT doc_id, pos, passage FROM p QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(lower(passage), '\s+', ' ', 'g')) ORDER BY doc_id, pos) = 1")
def dedupe_passages(spark, sf_dir):
    return x.dedupe_passages(passages(spark, sf_dir))


@query("flag_limitations", PASSAGES + "SELECT doc_id, pos, regexp_matches(lower(passage), '" + "|".join(x.LIMITATIONS) + "') AS is_limitation FROM p")
def flag_limitations(spark, sf_dir):
    return x.flag_limitations(passages(spark, sf_dir)).select("doc_id", "pos", "is_limitation")


@query("pack_passages", PASSAGES.replace("WITH d", "WITH RECURSIVE d") + """, w AS (SELECT doc_id, pos, CAST(length(passage) AS BIGINT) AS n FROM p), f AS (SELECT doc_id, pos, 0::BIGINT AS pack, n AS chars FROM w WHERE pos = 0
UNION ALL SELECT w.doc_id, w.pos, CASE WHEN f.chars + 2 + w.n <= 1000 THEN f.pack ELSE f.pack + 1 END, CASE WHEN f.chars + 2 + w.n <= 1000 THEN f.chars + 2 + w.n ELSE w.n END FROM f JOIN w ON w.doc_id = f.doc_id AND w.pos = f.pos + 1)
SELECT doc_id, pack, min(pos) AS first_pos, max(pos) AS last_pos, max(chars) AS chars FROM f GROUP BY 1, 2""")
def pack_passages(spark, sf_dir):
    return x.pack_passages(passages(spark, sf_dir), 1000)


SIZED = "SELECT source AS project, doc_id AS ord, n_chars AS chars, doc_id % 10 = 0 AS protected FROM {documents}"


@query("budget_passages", f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY NOT protected, ord) AS k FROM ({SIZED})),
f AS (SELECT project, 0::BIGINT AS k, 64000::BIGINT AS space, NULL::BIGINT AS ord FROM s GROUP BY 1 UNION ALL SELECT s.project, s.k, CASE WHEN s.chars <= f.space THEN f.space - s.chars ELSE f.space END, CASE WHEN s.chars <= f.space THEN s.ord END FROM f JOIN s ON s.project = f.project AND s.k = f.k + 1)
SELECT project, ord FROM f WHERE ord IS NOT NULL""")
def budget_passages(spark, sf_dir):
    return x.budget_passages(rows(spark, sf_dir, SIZED))


CONTEXT = "SELECT source AS project, doc_id, CASE WHEN doc_id % 9 = 0 THEN concat('--', chr(10), '***', chr(10), text) WHEN doc_id % 13 = 0 THEN '...' ELSE text END AS text FROM {documents}"
CONTEXT = f"SELECT project, doc_id, replace(text, chr(10), concat(chr(10), chr(10))) AS text FROM ({CONTEXT})"
SPACE = 20_000


@query("context_stats", f"""WITH RECURSIVE d AS ({CONTEXT}), b AS (SELECT project, doc_id, generate_subscripts(p, 1) AS block, regexp_replace(unnest(p), '^\\s+|\\s+$', '', 'g') AS piece FROM (SELECT project, doc_id, string_split(text, chr(10) || chr(10)) AS p FROM d)),
c AS (SELECT project, doc_id, block, spot, substring(piece, spot::BIGINT, {LIMIT}) AS passage FROM (SELECT *, unnest(generate_series(1, length(piece), {LIMIT})) AS spot FROM b WHERE piece <> '')),
h AS (SELECT * FROM c WHERE regexp_matches(passage, '[\\p{{L}}\\p{{N}}]')),
u AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY project, trim(regexp_replace(lower(passage), '\\s+', ' ', 'g')) ORDER BY doc_id, block, spot) = 1),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block, spot) AS k, length(passage)::BIGINT AS n, regexp_matches(lower(passage), '{"|".join(x.LIMITATIONS)}') AS limitation FROM u),
f AS (SELECT project, doc_id, k, 0::BIGINT AS pack, n AS chars, limitation FROM w WHERE k = 1 UNION ALL SELECT w.project, w.doc_id, w.k, CASE WHEN f.chars + 2 + w.n <= {LIMIT} THEN f.pack ELSE f.pack + 1 END, CASE WHEN f.chars + 2 + w.n <= {LIMIT} THEN f.chars + 2 + w.n ELSE w.n END, w.limitation FROM f JOIN w ON w.doc_id = f.doc_id AND w.k = f.k + 1),
g AS (SELECT project, doc_id, pack, max(chars) AS chars, bool_or(limitation) AS protected FROM f GROUP BY 1, 2, 3),
s AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY NOT protected, doc_id, pack) AS j FROM g),
t AS (SELECT project, 0::BIGINT AS j, {SPACE}::BIGINT AS space, NULL::BIGINT AS doc_id, NULL::BIGINT AS chars FROM s GROUP BY 1 UNION ALL SELECT s.project, s.j, CASE WHEN s.chars <= t.space THEN t.space - s.chars ELSE t.space END, CASE WHEN s.chars <= t.space THEN s.doc_id END, CASE WHEN s.chars <= t.space THEN s.chars END FROM t JOIN s ON s.project = t.project AND s.j = t.j + 1),
a AS (SELECT project, count(DISTINCT doc_id) AS ad, sum(chars)::BIGINT AS ac, count(doc_id) AS ak FROM t GROUP BY 1),
z AS (SELECT project, count(*) AS bd, sum(length(coalesce(text, '')))::BIGINT AS bc FROM d GROUP BY 1),
n AS (SELECT project, (SELECT count(*) FROM c WHERE c.project = z.project) AS nc, (SELECT count(*) FROM h WHERE h.project = z.project) AS nh, (SELECT count(*) FROM u WHERE u.project = z.project) AS nu, (SELECT count(*) FROM g WHERE g.project = z.project) AS ng FROM z)
SELECT project, bd AS before_documents, bc AS before_chars, coalesce(ad, 0) AS after_documents, coalesce(ac, 0) AS after_chars, (bc + 1) // 2 AS before_tokens, (coalesce(ac, 0) + 1) // 2 AS after_tokens, nc - nh AS noise, nh - nu AS duplicate, ng - coalesce(ak, 0) AS context_limit FROM z JOIN n USING (project) LEFT JOIN a USING (project)""")
def context_stats(spark, sf_dir):
    return x.context_stats(rows(spark, sf_dir, CONTEXT), SPACE, LIMIT)


QUOTES = """SELECT doc_id * 2 AS quote_id, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'no such words here' ELSE substring(text, 11, 40) END AS quote FROM {documents}
UNION ALL SELECT doc_id * 2 + 1, doc_id, CASE WHEN lang = 'en' THEN upper(replace(substring(text, 21, 60), ' ', '')) ELSE replace(substring(text, 21, 60), ' ', '') END FROM {documents}"""


#: The same rows in Spark, whose upper makes SS of ß.
PRESSED = "replace(substring(text, 21, 60), ' ', '')"
SPARK_QUOTES = QUOTES.replace(f"upper({PRESSED})", upper_each(PRESSED))


def fold(text: str) -> str:
    """The operator's folding of a text in SQL."""
    quoted = [v.replace("'", "''") for v in (x.IGNORED, x.WIDE, x.NARROW)]
    return f"lower(translate(regexp_replace(translate({text}, '{quoted[0]}', ''), '\\s', '', 'g'), '{quoted[1]}', '{quoted[2]}'))"


GROUNDED = f"""WITH q AS (SELECT q.*, d.text, instr(d.text, quote) AS spot FROM ({QUOTES}) q JOIN documents d USING (doc_id) WHERE length(quote) > 0),
e AS (SELECT quote_id, doc_id, spot - 1 AS start_offset, spot - 1 + length(quote) AS end_offset, true AS exact FROM q WHERE spot > 0),
r AS (SELECT quote_id, doc_id, {fold('quote')} AS needle, list_filter(list_transform(string_split(text, ''), lambda c, i: {{'c': {fold('c')}, 'i': i - 1}}), lambda x: x.c <> '') AS chars FROM q WHERE spot = 0),
s AS (SELECT *, instr(array_to_string(list_transform(chars, lambda x: x.c), ''), needle) AS spot FROM r WHERE needle <> ''),
g AS (SELECT * FROM e UNION ALL SELECT quote_id, doc_id, chars[spot].i, chars[spot + length(needle) - 1].i + 1, false FROM s WHERE spot > 0)
"""


@query("ground_quotes", GROUNDED + "SELECT * FROM g")
def ground_quotes(spark, sf_dir):
    return x.ground_quotes(rows(spark, sf_dir, SPARK_QUOTES), rows(spark, sf_dir, "SELECT doc_id, text FROM {documents}"))


@query("grounding_rate", GROUNDED + f", n AS (SELECT count(*) AS c FROM ({QUOTES})), m AS (SELECT count(*) AS k FROM g) SELECT c AS candidates, k AS grounded, round((c - k) / c, 9) AS unsupported_rate FROM n, m")
def grounding_rate(spark, sf_dir):
    return x.grounding_rate(rows(spark, sf_dir, SPARK_QUOTES), ground_quotes(spark, sf_dir))


ECHOES = "SELECT doc_id AS id, text AS stated, CASE doc_id % 4 WHEN 0 THEN upper(text) WHEN 1 THEN concat(source, substring(text, 8)) WHEN 2 THEN 'ab' ELSE source END AS latent FROM {documents}"


@query("need_echo", f"""WITH f AS (SELECT id, {fold('stated')} AS a, {fold('latent')} AS b FROM ({ECHOES})), g AS (SELECT *, list_distinct(list_transform(generate_series(1, greatest(length(a) - 1, 1)), lambda i: substring(a, i, 2))) AS ga, list_distinct(list_transform(generate_series(1, greatest(length(b) - 1, 1)), lambda i: substring(b, i, 2))) AS gb FROM f)
SELECT id, length(a) >= 4 AND length(b) >= 4 AND (contains(a, b) OR contains(b, a) OR len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))) >= 0.5) AS echo FROM g""")
def need_echo(spark, sf_dir):
    return x.need_echo(rows(spark, sf_dir, ECHOES.replace("upper(text)", upper_each("text"))))


TERMED = "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN '効 率とコ スパと安心' WHEN 1 THEN '満足感 text' ELSE source END AS text FROM {documents}"


@query("generic_terms", f"SELECT id, coalesce({', '.join(f'''CASE WHEN contains(replace(text, ' ', ''), '{t}') THEN '{t}' END''' for t in x.GENERIC)}) AS term FROM ({TERMED})")
def generic_terms(spark, sf_dir):
    return x.generic_terms(rows(spark, sf_dir, TERMED))


JUDGED = "SELECT doc_id AS id, doc_id % 3 = 0 AS echo, CASE WHEN doc_id % 4 = 0 THEN 'x' END AS term, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'e' END AS expectation, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 's' END AS surprising, CAST(n_chars % 6 AS INT) AS competing, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE 'need' END AS stated, CASE WHEN lang = 'en' THEN 'NEEDS' ELSE 'GENERAL' END AS profile FROM {documents}"
DEVIATES = "SELECT doc_id AS id FROM {labels} WHERE quality = 1"


@query("quality_flags", f"SELECT id, concat_ws(',', CASE WHEN echo AND stated = 'need' AND profile = 'NEEDS' THEN 'STATED_NEED_ECHO' END, CASE WHEN term IS NOT NULL AND stated = 'need' AND profile = 'NEEDS' THEN 'GENERIC_TERM' END, CASE WHEN id NOT IN ({DEVIATES}) THEN 'NO_DEVIATION_PATTERN' END, CASE WHEN trim(expectation) = '' OR surprising IS NULL THEN 'INCOMPLETE_EXPECTATION' END, CASE WHEN competing < 3 THEN 'FEW_COMPETING' END) AS flags FROM ({JUDGED})")
def quality_flags(spark, sf_dir):
    return x.quality_flags(rows(spark, sf_dir, JUDGED), rows(spark, sf_dir, DEVIATES), "NEEDS")


CITED = "SELECT conv_id AS finding_id, array(conv_id * 3 + 1, conv_id * 5, conv_id * 3 + 1, 999999, conv_id + 2, turn) AS observation_ids FROM {conversations} WHERE turn = 0"
EVIDENCE = f"""WITH c AS ({CITED.replace('array(', 'list_value(')}), e AS (SELECT finding_id, unnest(observation_ids) AS observation_id, generate_subscripts(observation_ids, 1) AS pos FROM c), m AS (SELECT finding_id, observation_id, min(pos) AS pos FROM e GROUP BY 1, 2),
ev AS (SELECT finding_id, observation_id, doc_id, CAST(row_number() OVER (PARTITION BY finding_id ORDER BY pos) - 1 AS INT) AS rank FROM m JOIN (SELECT doc_id AS observation_id, doc_id FROM documents) o USING (observation_id)),
er AS (SELECT *, round(greatest(0.5, 1 - 0.05 * rank)::DOUBLE, 2) AS relevance FROM ev)
"""


def _evidence(spark, sf_dir):
    return x.evidence_rows(rows(spark, sf_dir, CITED), rows(spark, sf_dir, "SELECT doc_id AS observation_id, doc_id FROM {documents}"))


@query("evidence_rows", EVIDENCE + "SELECT * FROM er")
def evidence_rows(spark, sf_dir):
    return _evidence(spark, sf_dir)


SHOWN = "SELECT conv_id AS finding_id, (conv_id * 7 + turn) % 500 AS doc_id FROM {conversations}"
CONFIDENCE = EVIDENCE + """, t AS (SELECT er.*, d.source, d.lang AS project, CASE WHEN d.doc_id % 4 = 0 THEN 'counter' ELSE 'support' END AS type FROM er JOIN documents d USING (doc_id)), n AS (SELECT lang AS project, count(*) AS n FROM documents GROUP BY 1),
a AS (SELECT project, finding_id, avg(relevance) FILTER (type = 'support') AS mean, count(DISTINCT doc_id) FILTER (type = 'support') AS docs, count(DISTINCT source) FILTER (type = 'support') AS sources, count(*) FILTER (type = 'support') AS supports, count(*) FILTER (type = 'counter') AS counters FROM t GROUP BY 1, 2),
sc AS (SELECT finding_id, supports, counters, CASE WHEN supports = 0 THEN 0 ELSE round(least(1, greatest(0, (0.35::DOUBLE * mean + 0.25::DOUBLE * least(1, docs / n) + 0.2::DOUBLE * least(1, sources / 5) + 0.2::DOUBLE * least(1, coalesce(shown, 0) / 5)) * (1 - 0.1::DOUBLE * least(counters, 3)))), 6) END AS confidence FROM a JOIN n USING (project) LEFT JOIN (SELECT finding_id, count(DISTINCT doc_id) AS shown FROM ({SHOWN}) GROUP BY 1) USING (finding_id))
""".replace("{SHOWN}", SHOWN)


def _confidence(spark, sf_dir):
    docs = rows(spark, sf_dir, "SELECT doc_id, source, lang AS project, CASE WHEN doc_id % 4 = 0 THEN 'counter' ELSE 'support' END AS type FROM {documents}")
    return x.evidence_confidence(_evidence(spark, sf_dir).join(docs, "doc_id"), rows(spark, sf_dir, "SELECT lang AS project, count(*) AS n FROM {documents} GROUP BY 1"), rows(spark, sf_dir, SHOWN))


@query("evidence_confidence", CONFIDENCE + "SELECT * FROM sc")
def evidence_confidence(spark, sf_dir):
    return _confidence(spark, sf_dir)


@query("validation_status", CONFIDENCE + "SELECT finding_id, CASE WHEN supports = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN counters >= supports THEN 'CONTRADICTED' WHEN counters > 0 THEN 'PARTIALLY_SUPPORTED' ELSE 'PLAUSIBLE' END AS status FROM sc")
def validation_status(spark, sf_dir):
    return x.validation_status(_confidence(spark, sf_dir))


PATTERNS = "SELECT conv_id AS id, CASE conv_id % 4 WHEN 0 THEN 'gap' WHEN 1 THEN 'weird' WHEN 2 THEN 'shift' ELSE NULL END AS deviation_type, array(conv_id * 9 + 3, conv_id * 30, conv_id) AS observation_ids FROM {conversations} WHERE turn = 0"


@query("filter_pattern_refs", f"WITH p AS ({PATTERNS.replace('array(', 'list_value(')}), e AS (SELECT id, deviation_type, unnest(observation_ids) AS o, generate_subscripts(observation_ids, 1) AS pos FROM p) SELECT id, CASE WHEN deviation_type IS NULL OR deviation_type IN ('gap', 'shift') THEN deviation_type ELSE 'other' END AS deviation_type, string_agg(CAST(o AS VARCHAR), ',' ORDER BY pos) AS observations FROM e WHERE o IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) GROUP BY id, e.deviation_type")
def filter_pattern_refs(spark, sf_dir):
    return x.filter_pattern_refs(rows(spark, sf_dir, PATTERNS), rows(spark, sf_dir, "SELECT doc_id AS observation_id FROM {documents} WHERE doc_id % 3 = 0"), ("gap", "shift"))


ALTERNATIVES = "SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE array(p_brand, p_type) END AS competing FROM {part}"


@query("expand_alternatives", f"WITH i AS ({ALTERNATIVES.replace('array(', 'list_value(')}) SELECT id AS set_id, 0 AS pos, 'PRIMARY' AS role, title, coalesce(len(competing), 0) + 1 AS set_size FROM i UNION ALL SELECT id, generate_subscripts(competing, 1), 'COMPETING', unnest(competing), len(competing) + 1 FROM i WHERE competing IS NOT NULL")
def expand_alternatives(spark, sf_dir):
    return x.expand_alternatives(rows(spark, sf_dir, ALTERNATIVES))


GROUPS = "SELECT o_custkey AS group_id, o_orderkey AS idx FROM {orders} WHERE o_orderstatus = 'P'"


@query("apply_duplicate_groups", f"WITH g AS ({GROUPS}) SELECT o_orderkey AS idx FROM orders WHERE o_orderkey NOT IN (SELECT idx FROM g JOIN (SELECT group_id, min(idx) AS low FROM g GROUP BY 1) USING (group_id) WHERE idx <> low)")
def apply_duplicate_groups(spark, sf_dir):
    return x.apply_duplicate_groups(rows(spark, sf_dir, "SELECT o_orderkey AS idx FROM {orders}"), rows(spark, sf_dir, GROUPS))


SCORED = "SELECT source AS run, doc_id % 3 AS supports, doc_id % 2 AS counters, n_chars > 2000 AS traced, doc_id % 7 < 3 AS searched, CASE WHEN doc_id % 5 = 0 THEN 'X' WHEN doc_id % 5 = 1 THEN 'A,X' ELSE '' END AS flags FROM {documents}"


@query("run_metrics", f"SELECT run, count(*) AS findings, round(count(*) FILTER (supports > 0) / count(*), 6) AS evidence_coverage, round(count(*) FILTER (searched) / count(*), 6) AS counter_coverage, round(avg(supports + counters), 6) AS mean_evidence, round(count(*) FILTER (traced) / count(*), 6) AS traced_rate, round(count(*) FILTER (flags <> '') / count(*), 6) AS flagged_rate, concat_ws(',', CASE WHEN count(*) FILTER (contains(flags, 'A')) > 0 THEN 'A=' || count(*) FILTER (contains(flags, 'A')) END, CASE WHEN count(*) FILTER (contains(flags, 'X')) > 0 THEN 'X=' || count(*) FILTER (contains(flags, 'X')) END) AS flag_counts FROM ({SCORED}) GROUP BY 1")
def run_metrics(spark, sf_dir):
    return x.run_metrics(rows(spark, sf_dir, SCORED))


VARIABLES = "SELECT o_custkey AS finding_id, o_orderpriority AS name, CASE o_orderkey % 3 WHEN 0 THEN 'CONFOUNDER' ELSE 'MEDIATOR' END AS role, CASE WHEN o_orderstatus = 'O' THEN 'SUPPORTED' ELSE 'PROPOSED' END AS status FROM {orders}"


@query("control_candidates", f"SELECT finding_id, name FROM ({VARIABLES}) WHERE role = 'CONFOUNDER' AND status = 'SUPPORTED'")
def control_candidates(spark, sf_dir):
    return x.control_candidates(rows(spark, sf_dir, VARIABLES))
