"""Queries of file sources: Spark writes the given tables as CSV or JSON to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions.shared import shared_path
from quillspan.plans.registry import query, rows
from quillspan.sources import files as f

DOCS = """SELECT CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 = 0 THEN 'same' ELSE CAST(doc_id AS STRING) END AS id, CASE WHEN doc_id % 11 = 0 THEN 'blog' WHEN doc_id % 2 = 0 THEN 'web' ELSE 'report' END AS source, source AS title, CASE WHEN doc_id % 13 = 0 THEN '   ' ELSE concat('"', text) END AS content FROM {documents}"""
#: The documents as one CSV file for each of their sources, in order of their ids.
ORDERED = f"SELECT d.*, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS row FROM (SELECT doc_id, {DOCS[7:]}) d"
JUDGED = f"WITH d AS (SELECT title AS file, * FROM ({ORDERED})), j AS (SELECT *, CASE WHEN source = 'blog' THEN 'invalid source' WHEN trim(content) = '' THEN 'empty content' END AS reason FROM d), k AS (SELECT *, reason IS NULL AND id <> '' AND row > min(CASE WHEN reason IS NULL THEN row END) OVER (PARTITION BY file, id) AS twice FROM j)\n"


def _files(spark, sf_dir):
    path = shared_path(spark, "documents-csv")
    own = rows(spark, sf_dir, f"SELECT doc_id, {DOCS[7:]}").withColumn("file", F.col("title"))
    own.repartition("file").sortWithinPartitions("file", "doc_id").drop("doc_id").write.partitionBy("file").csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def _read(spark, path):
    return f.documents_csv_scan(spark, f"{path}/*")


def _named(found):
    """With the file's folder, which is the documents' source, as its name."""
    return found.withColumn("file", F.regexp_extract("file", "file=([^/]*)", 1))


def _id():
    return F.coalesce("id", F.lit(""))


@query("documents_csv_scan", JUDGED + "SELECT file, row, id, source, title, sha256(content) AS content_sha FROM d")
def documents_csv_scan(spark, sf_dir):
    return _named(_read(spark, _files(spark, sf_dir))).select("file", "row", _id().alias("id"), "source", "title", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha"))


@query("row_quarantine", JUDGED + "SELECT file, row, reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT file, count(*), 'valid' FROM j WHERE reason IS NULL GROUP BY 1")
def row_quarantine(spark, sf_dir):
    valid, rejects = f.row_quarantine(_read(spark, _files(spark, sf_dir)))
    counts = _named(valid).groupBy("file").agg(F.count("*").alias("row")).withColumn("reason", F.lit("valid"))
    return _named(rejects).select("file", "row", "reason").unionByName(counts)


@query("ingest_row_dedupe", JUDGED + "SELECT file, row, id, twice FROM k WHERE reason IS NULL")
def ingest_row_dedupe(spark, sf_dir):
    kept, again = f.ingest_row_dedupe(f.row_quarantine(_read(spark, _files(spark, sf_dir)))[0])
    rows_of = lambda found, twice: _named(found).select("file", "row", _id().alias("id"), F.lit(twice).alias("twice"))
    return rows_of(kept, False).unionByName(rows_of(again, True))


EVENTS = """SELECT CASE WHEN event_id % 23 = 0 THEN '' ELSE CAST(user_id AS STRING) END AS corporate_number, CASE event_type WHEN 'click' THEN 'ASSIGNED' WHEN 'view' THEN 'UPDATED' WHEN 'error' THEN 'CHANGED' ELSE 'CLOSED' END AS event_type, concat('pref', CAST(user_id % 4 AS STRING)) AS prefecture_name, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'city' END AS city_name,
  substring(CAST(ts AS STRING), 1, 10) AS assignment_date, substring(CAST(ts AS STRING), 1, 10) AS update_date, CASE WHEN event_id % 7 = 0 THEN '2024-02-30' ELSE substring(CAST(ts AS STRING), 1, 10) END AS change_date, CASE WHEN event_id % 5 = 0 THEN '' ELSE '2024-03-01' END AS close_date, CASE WHEN event_id % 29 = 0 THEN ' ' ELSE 'p' END AS source_provider, 'v1' AS source_version, concat('f', CAST(event_id % 3 AS STRING)) AS source_fetched_at FROM {events}"""
ROLLED = f"WITH e AS ({EVENTS}), d AS (SELECT *, CASE event_type WHEN 'ASSIGNED' THEN assignment_date WHEN 'UPDATED' THEN update_date WHEN 'CHANGED' THEN change_date ELSE close_date END AS date FROM e), g AS (SELECT substring(date, 1, 7) AS period, event_type, prefecture_name, city_name, source_provider, source_version, count(*) AS record_count, min(source_fetched_at) AS source_fetched_at FROM d WHERE corporate_number <> '' AND date NOT IN ('', '2024-02-30') AND trim(source_provider) <> '' GROUP BY ALL)\n"


def _groups(spark, sf_dir):
    path = shared_path(spark, "events-csv")
    rows(spark, sf_dir, EVENTS).write.csv(path, header=True, escape='"')
    return f.event_csv_rollup(f.event_csv_scan(spark, path))[0]


@query("event_csv_rollup", ROLLED + "SELECT * FROM g")
def event_csv_rollup(spark, sf_dir):
    return _groups(spark, sf_dir)


@query("rollup_documents", ROLLED + "SELECT concat_ws('|', period, event_type, prefecture_name, city_name, source_provider, source_version) AS key, period || ' ' || trim(prefecture_name || ' ' || city_name) || ' ' || event_type || ' (' || record_count || ' records)' AS title, 'Records of ' || event_type || ' in ' || trim(prefecture_name || ' ' || city_name) || ' during ' || period || ': ' || record_count || ' (provider ' || source_provider || ', version ' || source_version || ').' AS content FROM g")
def rollup_documents(spark, sf_dir):
    return f.rollup_documents(_groups(spark, sf_dir))


@query("ingest_receipt", JUDGED + """, r AS (SELECT file, row, coalesce(reason, CASE WHEN twice THEN 'duplicate id' END) AS reason FROM k), few AS (SELECT * FROM r WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file ORDER BY row) <= 50)
SELECT file, count(*) AS rows_read, count(*) FILTER (reason IS NULL) AS created, count(reason) AS skipped, coalesce((SELECT string_agg(row || ':' || reason, ',' ORDER BY row) FROM few WHERE few.file = r.file), '') AS examples, true AS hashed FROM r GROUP BY 1""")
def ingest_receipt(spark, sf_dir):
    path = _files(spark, sf_dir)
    valid, rejects = f.row_quarantine(_read(spark, path))
    kept, again = f.ingest_row_dedupe(valid)
    return _named(f.ingest_receipt(kept, rejects.unionByName(again), hashes=f.file_hashes(spark, f"{path}/*"))).withColumn("hashed", F.length("sha256") == 64).drop("sha256")


FILES = "SELECT DISTINCT o_custkey AS project, o_orderstatus AS kind, o_orderpriority AS file_hash, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS manifest_hash, '' AS request_key FROM {orders}"
RECEIPTS = "SELECT o_custkey AS project, o_orderstatus AS kind, o_orderpriority AS file_hash, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS manifest_hash, '' AS request_key, CASE o_orderkey % 3 WHEN 0 THEN 'READY' WHEN 1 THEN 'LIVE' ELSE 'FAILED' END AS status FROM {orders}"


@query("ingest_identity_dedupe", f"SELECT * FROM ({FILES}) f WHERE NOT EXISTS (SELECT 1 FROM ({RECEIPTS}) r WHERE r.project = f.project AND r.kind = f.kind AND r.file_hash = f.file_hash AND r.manifest_hash IS NOT DISTINCT FROM f.manifest_hash AND status <> 'FAILED')")
def ingest_identity_dedupe(spark, sf_dir):
    return f.ingest_identity_dedupe(rows(spark, sf_dir, FILES), rows(spark, sf_dir, RECEIPTS))


OWNED = "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 25 END AS ingest_id FROM {documents}"
INGESTS = "SELECT n_nationkey AS ingest_id, CASE WHEN n_nationkey % 3 = 0 THEN 'READY' ELSE 'STAGED' END AS status FROM {nation}"


@query("visible_documents", f"SELECT id, ingest_id FROM ({OWNED}) WHERE ingest_id IS NULL OR ingest_id IN (SELECT ingest_id FROM ({INGESTS}) WHERE status = 'READY')")
def visible_documents(spark, sf_dir):
    return f.visible_documents(rows(spark, sf_dir, OWNED), rows(spark, sf_dir, INGESTS))


@query("import_preview", JUDGED + "SELECT file, row, id, source, (SELECT count(*) FROM j WHERE reason IS NULL) AS valid, (SELECT count(*) FROM j WHERE reason IS NOT NULL) AS rejected FROM j WHERE reason IS NULL ORDER BY file, row LIMIT 5")
def import_preview(spark, sf_dir):
    return _named(f.import_preview(*f.row_quarantine(_read(spark, _files(spark, sf_dir))))).withColumn("id", _id())


@query("raw_file_verify")
def raw_file_verify(spark, sf_dir):
    """Every file of the documents as Spark writes them; of the claims one in three has a wrong hash, one in five none."""
    path = shared_path(spark, "raw-files")
    rows(spark, sf_dir, "SELECT doc_id, text FROM {documents}").repartition(16, "doc_id").write.parquet(path)
    measured = f.raw_file_verify(spark, path)
    part = F.regexp_extract("file", r"^part-([0-9]+)", 1).cast("int")
    claims = measured.select("file", F.when(part % 3 == 0, F.lit("0" * 64)).when(part % 5 > 0, F.col("sha256")).alias("sha256"), "size")
    return f.raw_file_verify(spark, path, claims).groupBy("verified").agg(F.count("*").alias("files"), F.sum((F.col("size") > 0).cast("long")).alias("sized"))


RESULTS = "SELECT o_orderpriority AS artifact_id, CAST(year(o_orderdate) AS STRING) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM {orders} GROUP BY 1, 2"


@query("artifact_json_scan", f"SELECT artifact_id, 'revenue' AS metric_id, period, value FROM ({RESULTS})")
def artifact_json_scan(spark, sf_dir):
    own = rows(spark, sf_dir, RESULTS).groupBy("artifact_id").agg(F.collect_list(F.struct(F.lit("revenue").alias("metric_id"), "period", "value")).alias("results")).withColumn("unknown", F.lit(1))
    path = shared_path(spark, "artifacts-json")
    f.artifact_json_write(own, path)
    return f.artifact_json_scan(spark, path).select("artifact_id", F.explode("results").alias("r")).select("artifact_id", "r.metric_id", "r.period", "r.value")


@query("artifact_json_write", f"SELECT artifact_id, count(*) AS results FROM ({RESULTS}) GROUP BY 1")
def artifact_json_write(spark, sf_dir):
    own = rows(spark, sf_dir, RESULTS).groupBy("artifact_id").agg(F.collect_list(F.struct(F.lit("revenue").alias("metric_id"), "period", "value")).alias("results"))
    path = shared_path(spark, "artifacts-json")
    f.artifact_json_write(own, path)
    lines = spark.read.text(path)  # one JSON value a line
    return lines.select(F.get_json_object("value", "$.artifact_id").alias("artifact_id"), F.size(F.from_json(F.get_json_object("value", "$.results"), "array<struct<metric_id:string>>")).cast("long").alias("results"))


STAMPED = "SELECT doc_id AS id, source AS file, lang FROM {documents}"
STAMPS = "SELECT concat('src', CAST(n_nationkey AS STRING)) AS file, md5(n_name) AS file_hash, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS source_name FROM {nation} WHERE n_nationkey % 4 > 0"


@query("provenance_stamp", f"SELECT d.id, d.file, concat_ws(',', CASE WHEN s.file_hash IS NOT NULL THEN 'file_hash=' || s.file_hash END, 'lang=' || d.lang, CASE WHEN s.source_name IS NOT NULL THEN 'source_name=' || s.source_name END) AS metadata FROM ({STAMPED}) d LEFT JOIN ({STAMPS}) s USING (file)")
def provenance_stamp(spark, sf_dir):
    docs = rows(spark, sf_dir, STAMPED).select("id", "file", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    out = f.provenance_stamp(docs, rows(spark, sf_dir, STAMPS))
    return out.select("id", "file", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("metadata"))
