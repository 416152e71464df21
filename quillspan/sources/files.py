"""File sources and sinks with quarantine: document and event CSV, artifact JSON, raw files, receipts, provenance.

Rejected rows always carry the file, their row number and the first matching reason. A row number counts a file's records
after the header from 1, however the file is split: records are counted a split, and the counts of the splits before are
added. ``multi_line`` reads quoted line breaks but cannot split a file; without it large files are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.shared import written

#: Accepted sources of documents.
SOURCES = ("document", "report", "paper", "web", "record", "other", "dataset", "interview", "review", "support", "sales", "survey", "job_posting", "social_post")
DOCUMENT = "id STRING, source STRING, title STRING, content STRING, _corrupt STRING"
#: Columns of event files.
EVENT_FIELDS = ("corporate_number", "event_type", "prefecture_name", "city_name", "assignment_date", "update_date", "change_date", "close_date", "source_provider", "source_version", "source_fetched_at")
ARTIFACT = """artifact_id STRING, schema STRING, version STRING, producer STRING, producer_version STRING, generated_at STRING, artifact_hash STRING, spec STRUCT<kind: STRING, reference: STRING, hash: STRING>, population STRING,
 datasets ARRAY<STRUCT<id: STRING, version: STRING, hash: STRING>>, metrics ARRAY<STRUCT<id: STRING, name: STRING, unit: STRING, version: STRING>>, provenance ARRAY<STRUCT<dataset_id: STRING, source: STRING, retrieved_at: STRING>>,
 results ARRAY<STRUCT<metric_id: STRING, period: STRING, basis: STRING, dims: MAP<STRING, STRING>, value: DOUBLE, missing: BOOLEAN>>"""
EXAMPLES = 50
#: Splits of files whose counts are sent to every task; rows whose places are ranked in one task.
FEW_SPLITS, STRETCH = 65_536, 100_000
IDENTITY = ("project", "kind", "file_hash", "manifest_hash", "request_key")


def numbered(read: DataFrame) -> DataFrame:
    """``read``, a plain read of files, with ``file`` (its path) and ``row``, the record's place in it from 0.

    A task reads the records of a split in order, so numbers that rise within a task tell the place in the split; the records of
    the splits before come from one count of the files. Only that count, a row a split, is sent to the tasks or joined.
    """
    marked = read.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))
    counts = written(marked.groupBy("file", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), "file-splits")
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_split")) - F.col("_n")
    starts = counts.select("file", "_split", (before - F.col("_first")).alias("_shift"))
    if counts.count() <= FEW_SPLITS:
        starts = F.broadcast(starts)
    return marked.join(starts, ["file", "_split"]).withColumn("row", F.col("_at") + F.col("_shift")).drop("_split", "_at", "_shift")


def _csv(spark: SparkSession, path: str, schema: str, multi_line: bool, check: bool) -> DataFrame:
    """Rows of CSV files read byte by byte, so that bytes that are no UTF-8 are known from characters that stand for such:
    the schema's columns decoded, ``bad_bytes``, ``file`` and ``row``. With ``check`` the first record of a file must hold
    these names, else the read fails; it is no row. Without it the first record is skipped unread."""
    raw = spark.read.schema(schema).csv(path, header=False, multiLine=multi_line, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True, encoding="ISO-8859-1")
    raw = numbered(raw)
    columns = [c for c in raw.columns if c not in ("_corrupt", "file", "row")]
    data = {c: F.encode(c, "ISO-8859-1") for c in columns}
    good = lambda c: F.coalesce(F.is_valid_utf8(data[c].cast("string")), F.lit(True))
    bad = ~good(columns[0])
    for c in columns[1:]:
        bad = bad | ~good(c)
    rows = raw.select(*[F.decode(F.make_valid_utf8(data[c].cast("string")).cast("binary"), "UTF-8").alias(c) for c in columns], "_corrupt", bad.alias("bad_bytes"), "file", "row")
    if not check:
        return rows.filter("row > 0")
    is_header = F.lit(True)
    for c in columns:  # a file may start with a byte order mark
        is_header = is_header & (F.lower(F.trim(F.regexp_replace(c, "^\ufeff", ""))) == c)
    wrong = F.raise_error(F.concat(F.lit(f"CSV header must be {','.join(columns)}: "), "file")).cast("boolean")
    return rows.filter(F.when(F.col("row") > 0, True).when(F.coalesce(is_header, F.lit(False)), False).otherwise(wrong))


def documents_csv_scan(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Raw rows of document CSV files: id, source, title, content, _corrupt, bad_bytes, file and row. Each file's header must
    name these four columns in this order, else reading fails."""
    return _csv(spark, path, DOCUMENT, multi_line, True)


def row_quarantine(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of raw document rows. Reasons in order: bad bytes, a malformed row, an unknown source, no content."""
    reason = (
        F.when(F.col("bad_bytes"), "invalid UTF-8")
        .when(F.col("_corrupt").isNotNull(), "malformed row")
        .when(~F.coalesce(F.lower(F.trim("source")).isin(*SOURCES), F.lit(False)), "invalid source")
        .when(F.coalesce(F.trim("content"), F.lit("")) == "", "empty content")
    )
    marked = raw.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason", "_corrupt", "bad_bytes"), marked.filter("reason is not null").select("file", "row", "id", "reason")


def ingest_row_dedupe(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejects): of a file's rows with one non-empty id the one with the least ``row`` stays; empty ids all stay.

    The least row of an id is found before the rows are shuffled, and only that row has a partner in the join, so an id that
    many rows share is dealt evenly.
    """
    named = F.coalesce(F.trim("id"), F.lit("")) != ""
    first = rows.filter(named).groupBy("file", "id").agg(F.min("row").alias("row"))
    kept = rows.filter(named).join(first, ["file", "id", "row"], "left_semi").select(*rows.columns).unionByName(rows.filter(~named))
    return kept, rows.filter(named).join(first, ["file", "id", "row"], "left_anti").select("file", "row", "id", F.lit("duplicate id").alias("reason"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) of each file under ``path``; a file is read whole by one task, 2 GiB at most."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def event_csv_scan(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, ", ".join(f"{c} STRING" for c in EVENT_FIELDS) + ", _corrupt STRING", False, False)


def event_csv_rollup(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, rejects) of event rows: counts per month, type, place, provider and version. The type picks the date."""
    own = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in EVENT_FIELDS}
    kind = own["event_type"]
    date = F.when(kind == "ASSIGNED", own["assignment_date"]).when(kind == "UPDATED", own["update_date"]).when(kind == "CHANGED", own["change_date"]).when(kind == "CLOSED", own["close_date"]).otherwise("")
    good = date.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), date), F.lit("yyyy-MM-dd")).isNotNull()
    reason = F.when(own["corporate_number"] == "", "corporate_number is empty").when(~good, "event date is unavailable or invalid").when(own["source_provider"] == "", "source_provider is empty")
    rows = events.select(F.substring(date, 1, 7).alias("period"), *[own[c].alias(c) for c in ("event_type", "prefecture_name", "city_name", "source_provider", "source_version", "source_fetched_at", "corporate_number")], reason.alias("reason"))
    keys = ["period", "event_type", "prefecture_name", "city_name", "source_provider", "source_version"]
    groups = rows.filter("reason is null").groupBy(*keys).agg(F.count("*").alias("record_count"), F.min("source_fetched_at").alias("source_fetched_at"))
    return groups, rows.filter("reason is not null").select("corporate_number", "event_type", "reason")


def rollup_documents(groups: DataFrame) -> DataFrame:
    """One dataset document a group: key, title, content. The count is of records and claims no cause."""
    place = F.trim(F.concat_ws(" ", "prefecture_name", "city_name"))
    place = F.when(place == "", "unspecified").otherwise(place)
    count = F.col("record_count").cast("string")
    title = F.concat("period", F.lit(" "), place, F.lit(" "), "event_type", F.lit(" ("), count, F.lit(" records)"))
    content = F.concat(F.lit("Records of "), "event_type", F.lit(" in "), place, F.lit(" during "), "period", F.lit(": "), count, F.lit(" (provider "), "source_provider", F.lit(", version "), "source_version", F.lit(")."))
    return groups.select(F.concat_ws("|", "period", "event_type", "prefecture_name", "city_name", "source_provider", "source_version").alias("key"), title.alias("title"), content.alias("content"))


def ingest_receipt(valid: DataFrame, rejects: DataFrame, examples: int = EXAMPLES, hashes: DataFrame | None = None) -> DataFrame:
    """Per file: rows read, created and skipped, the first ``examples`` rejected rows with their reasons, and the hash of the
    file where ``hashes`` (file, sha256) has it. A file whose rows are all rejected, or that has none, has a receipt too, the
    latter if its hash is given.

    First rows are ranked by stretches of a file and then among their first ones, so a file of many rejects is ranked in many
    tasks.
    """
    first = lambda rows, *by: rows.withColumn("k", F.row_number().over(Window.partitionBy("file", *by).orderBy("row", "reason"))).filter(F.col("k") <= examples)
    few = first(first(rejects.withColumn("stretch", F.expr(f"row div {STRETCH}")), "stretch"))
    shown = few.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "reason"))), lambda e: F.concat(e["row"].cast("string"), F.lit(":"), e["reason"])), ",").alias("examples"))
    made = valid.groupBy("file").agg(F.count("*").alias("created"))
    lost = rejects.groupBy("file").agg(F.count("*").alias("skipped"))
    rows = made.join(lost, "file", "full")
    rows = rows.join(hashes.select("file", "sha256"), "file", "full") if hashes is not None else rows.withColumn("sha256", F.lit(None).cast("string"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.join(shown, "file", "left").select("file", (count("created") + count("skipped")).alias("rows_read"), count("created").alias("created"), count("skipped").alias("skipped"), F.coalesce("examples", F.lit("")).alias("examples"), "sha256")


def ingest_identity_dedupe(files: DataFrame, receipts: DataFrame) -> DataFrame:
    """Files (project, kind, file_hash, manifest_hash, request_key) without those that a live or ready ingest has already;
    no manifest is the same as no manifest."""
    live = receipts.filter(F.col("status").isin("READY", "LIVE")).select(*[F.col(c).alias("l_" + c) for c in IDENTITY]).distinct()
    same = F.lit(True)
    for c in IDENTITY:
        same = same & (F.col(c).eqNullSafe(F.col("l_" + c)) if c == "manifest_hash" else F.col(c) == F.col("l_" + c))
    return files.join(live, same, "left_anti")


def visible_documents(docs: DataFrame, ingests: DataFrame) -> DataFrame:
    """Documents (id, ingest_id) of ready ingests, and those without an ingest."""
    ready = ingests.filter("status = 'READY'").select("ingest_id")
    return docs.filter("ingest_id is null").unionByName(docs.filter("ingest_id is not null").join(ready, "ingest_id", "left_semi").select(*docs.columns))


def import_preview(valid: DataFrame, rejects: DataFrame, first: int = 5) -> DataFrame:
    """The ``first`` valid rows in order of file and row, each with the counts of a dry run."""
    n = valid.agg(F.count("*").alias("valid")).join(rejects.agg(F.count("*").alias("rejected")))
    return valid.orderBy("file", "row").limit(first).select("file", "row", "id", "source").join(F.broadcast(n))


def raw_file_verify(spark: SparkSession, path: str, claims: DataFrame | None = None) -> DataFrame:
    """Size and SHA-256 of each file against claims (file, sha256, size); empty claims are filled from the measurement.

    A file is read whole by one task, so it must fit in a task's memory (2 GiB at most).
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    if claims is None:
        return rows.withColumn("verified", F.lit(True))
    c = claims.select("file", F.col("sha256").alias("claimed"), F.col("size").alias("claimed_size"))
    good = (F.coalesce("claimed", "sha256") == F.col("sha256")) & (F.coalesce("claimed_size", "size") == F.col("size"))
    return rows.join(c, "file", "left").select("file", "size", "sha256", good.alias("verified"))


def artifact_json_scan(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Artifacts of JSON files; unknown fields are left out, absent ones are NULL. One value a line, or with ``multi_line`` one
    value a file over any number of lines."""
    return spark.read.schema(ARTIFACT).json(path, multiLine=multi_line)


def artifact_json_write(artifacts: DataFrame, path: str) -> None:
    artifacts.write.json(path)


def provenance_stamp(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Documents (id, file, metadata MAP) with their file's hash and manifest source in the map; what the row has wins."""
    rows = docs.join(files, "file", "left")
    added = F.map_filter(F.create_map(F.lit("file_hash"), F.col("file_hash"), F.lit("source_name"), F.col("source_name")), lambda k, v: v.isNotNull() & ~F.map_contains_key(F.coalesce("metadata", F.create_map().cast("map<string,string>")), k))
    return rows.select("id", "file", F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), added).alias("metadata"))
