"""The registered queries of this subpackage, one an operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import bpe, decontaminate, exact_dedup, filter_audit, html_text, langid, lm, mixing, resample, simhash, toxicity, url_filter, vptree
from quillspan.sources.tables import table

#: The rules of op4: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5, factor=1.1)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), rules)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.root_weights(docs))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), radius=4, width=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def vocabulary() -> bytes:
    """The ranks of the tokenizer; read on the driver, sent with the tasks."""
    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.fail_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(masks, "ABCDE")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["last"] - span["first"] + 1)
    items = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (hit > 0).alias("contaminated"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, longest=1, buckets=10_000, seed=2024)


OP4_SQL = """
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, row_number() OVER () AS rid
  FROM pages
), rules(rh, rp, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT p.rid, r.rh || r.rp AS rule, r.verdict, row_number() OVER (PARTITION BY p.rid ORDER BY length(r.rh || r.rp) DESC, length(r.rh) DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.rid = p.rid AND f.k = 1
"""

OP5_SQL = """
WITH RECURSIVE counts AS (
  SELECT coalesce(source, '') AS source, floor(sqrt(count(*)))::BIGINT AS weight, ((count(*) + 31) // 32)::BIGINT AS blocks FROM documents GROUP BY 1
), one AS (
  SELECT list(source ORDER BY source) AS names, list(weight ORDER BY source) AS weights, list(blocks ORDER BY source) AS blocks, sum(weight)::BIGINT AS total FROM counts
), edf AS (
  SELECT -1::BIGINT AS slot, 0::BIGINT AS pick, 0::BIGINT AS turn, list_transform(weights, lambda u: 0::BIGINT) AS done FROM one
  UNION ALL
  SELECT slot, pick, done[pick], list_transform(done, lambda b, i: CASE WHEN i = pick THEN b + 1 ELSE b END)
  FROM (
    SELECT n.slot, n.done, list_min(list_filter(list_transform(n.done, lambda b, i:
      CASE WHEN b < o.blocks[i] AND (b * o.total) // o.weights[i] <= n.slot
           THEN (((b + 1) * o.total + o.weights[i] - 1) // o.weights[i]) * 100000 + i ELSE NULL END), lambda x: x IS NOT NULL)) % 100000 AS pick
    FROM (
      SELECT e.done, greatest(e.slot + 1, list_min(list_filter(list_transform(e.done, lambda b, i:
        CASE WHEN b < p.blocks[i] THEN (b * p.total) // p.weights[i] ELSE NULL END), lambda x: x IS NOT NULL))) AS slot
      FROM edf e, one p WHERE list_sum(e.done) < list_sum(p.blocks)
    ) n, one o
  )
), plan AS (
  SELECT o.names[e.pick] AS source, o.weights[e.pick] AS weight, o.total, e.turn, e.slot FROM edf e, one o WHERE e.slot >= 0
), ranked AS (
  SELECT doc_id, source AS named, coalesce(source, '') AS source,
         row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY coalesce(md5(doc_id::VARCHAR), ''), doc_id) - 1 AS r
  FROM documents
)
SELECT r.doc_id, r.named AS source, r.r // 32 AS block, ((r.r // 32) * p.total) // p.weight AS release,
       ((r.r // 32 + 1) * p.total + p.weight - 1) // p.weight AS deadline, p.slot, p.slot * 32 + r.r % 32 AS position
FROM ranked r JOIN plan p ON p.source = r.source AND p.turn = r.r // 32
"""

OP7_SQL = """
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents
), ranked AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept
  FROM norm
)
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM ranked
"""

OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), masks AS (
  SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (d.doc_id IS DISTINCT FROM min(d.doc_id) OVER (PARTITION BY text))::INT AS mask
  FROM words d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1) l USING (doc_id)
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY ALL
), letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
  SELECT filter_order, step::INT AS step, l.bit AS own, coalesce((SELECT sum(k.bit) FROM letters k WHERE instr(filter_order, k.f) < step), 0)::INT AS before
  FROM orders, range(1, 6) s(step), letters l WHERE l.f = substr(filter_order, step, 1)
), counted AS (
  SELECT part, filter_order, step, own,
         sum(n) FILTER (mask & (before | own) = 0) AS kept, sum(n) FILTER (mask & own <> 0 AND mask & before = 0) AS removed,
         sum(n) FILTER (mask & own <> 0 AND mask & before <> 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
         sum(good) FILTER (mask & own <> 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM counted
"""

OP12_SQL = r"""
WITH low AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item, w, least(len(w), 10) AS k FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
), places AS (
  SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM low, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k
), hits AS (
  SELECT rid, i, k, item FROM (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM places) JOIN windows USING (k, g)
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1
), found AS (
  SELECT rid, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items, coalesce(f.sha, sha256('')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM low LEFT JOIN covered c USING (rid) LEFT JOIN found f USING (rid)
"""

#: CRC-32 byte by byte over distinct words, with its table from the reversed polynomial 0xEDB88320.
OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT 0 AS k, i AS byte, i::BIGINT AS v FROM range(256) t(i)
  UNION ALL SELECT k + 1, byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY byte) AS t FROM bits WHERE k = 8),
texts AS (
  SELECT row_number() OVER () AS rid, doc_id, 0 AS side, text FROM documents UNION ALL SELECT -row_number() OVER (), item_id, 1, text FROM benchmark
), tokens AS (
  SELECT rid, side, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), uses AS (SELECT rid, side, word, count(*) AS n FROM tokens GROUP BY ALL),
vocabulary AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i::INT + 1, 2))::BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM uses), crc
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM uses JOIN vocabulary USING (word) GROUP BY 1
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS gain FROM counts
), sums AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM uses JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN sums USING (rid) WHERE side = 0
), ranked AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(place) FROM ranked) // 100 THEN place END AS rank FROM ranked
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_nearest_neighbours, op3_lm_scoring, op4_url_filters, op5_mixing, op6_simhash, op7_exact_dedup, op8_byte_bpe, op9_language_id, op10_toxicity, op11_filter_audit, op12_decontamination, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": OP4_SQL, "op5_mixing": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op11_filter_audit": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_importance_resampling": OP13_SQL}
