"""Artifact tables: constraint checks, conflicts, keys, statements, and forbidden phrases of evaluation cases.

Checks return violations, one row each; no violation means no row.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.operators.compare import ORIGINS, VALUE_BASES
from quillspan.operators.temporal import calendar_index

HASH = "^[0-9a-fA-F]{64}$"
#: Of a case: reports that one task reads, phrases of one automaton, about.
REPORTS_A_PART, PHRASES_A_SHARD = 2_000, 20_000


def _codes(df: DataFrame, *keys: str, **codes) -> DataFrame:
    own = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), name) for name, c in codes.items()]))
    return df.select(*keys, F.explode(own).alias("code"))


def blank(c: str):
    return F.coalesce(F.trim(c), F.lit("")) == ""


def validate_artifacts(artifacts: DataFrame, metrics: DataFrame, results: DataFrame, datasets: DataFrame, provenance: DataFrame, schema: tuple[str, str]) -> DataFrame:
    """(artifact_id, code), one row a violated rule of each artifact.

    artifacts: artifact_id, schema, version, producer, producer_version, generated_at, artifact_hash, subject_namespace,
    subject_id, spec_kind, spec_reference, spec_hash, period_start, period_end, population, engine, engine_version,
    deterministic. metrics: artifact_id, metric_id, name, unit. results: artifact_id, metric_id, period_start, period_end,
    value, missing. datasets: artifact_id, dataset_id, version, hash. provenance: artifact_id, dataset_id, source,
    retrieved_at. ``schema``: name and version that are supported. Rows of unknown artifacts are judged too.
    """
    hashed = lambda c: F.coalesce(F.col(c).rlike(HASH), F.lit(False))
    backward = F.coalesce(F.col("period_start") > F.col("period_end"), F.lit(True))
    subject = F.col("subject_namespace").isNotNull() | F.col("subject_id").isNotNull()
    lacks = lambda rows, code: artifacts.select("artifact_id").join(rows, "artifact_id", "left_anti").select("artifact_id", F.lit(code).alias("code"))
    twice = lambda rows, key, code: rows.groupBy("artifact_id", key).count().filter("count > 1").select("artifact_id", F.lit(code).alias("code"))
    astray = lambda rows, known, key, code: rows.join(known, ["artifact_id", key], "left_anti").select("artifact_id", F.lit(code).alias("code"))
    found = [
        _codes(
            artifacts,
            "artifact_id",
            UNSUPPORTED_SCHEMA=~(F.col("schema").eqNullSafe(schema[0]) & F.col("version").eqNullSafe(schema[1])),
            PRODUCER_REQUIRED=blank("producer") | blank("producer_version") | F.col("generated_at").isNull(),
            SUBJECT_INCOMPLETE=subject & (blank("subject_namespace") | blank("subject_id")),
            BAD_HASH=~hashed("artifact_hash"),
            SPEC_REQUIRED=blank("spec_kind") | blank("spec_reference"),
            BAD_SPEC_HASH=~hashed("spec_hash"),
            BAD_PERIOD=backward,
            POPULATION_REQUIRED=blank("population"),
            COMPUTATION_REQUIRED=blank("engine") | blank("engine_version") | ~F.coalesce("deterministic", F.lit(False)),
        ),
        lacks(datasets, "DATASETS_REQUIRED"),
        lacks(metrics, "METRICS_REQUIRED"),
        lacks(results, "RESULTS_REQUIRED"),
        lacks(provenance, "PROVENANCE_REQUIRED"),
        _codes(datasets, "artifact_id", DATASET_INCOMPLETE=blank("dataset_id") | blank("version"), BAD_DATASET_HASH=~hashed("hash")),
        twice(datasets, "dataset_id", "DUPLICATE_DATASET"),
        _codes(metrics, "artifact_id", METRIC_INCOMPLETE=blank("metric_id") | blank("name") | blank("unit")),
        twice(metrics, "metric_id", "DUPLICATE_METRIC"),
        astray(results, metrics, "metric_id", "UNKNOWN_METRIC"),
        _codes(results, "artifact_id", BAD_RESULT_PERIOD=backward, MISSING_MISMATCH=F.col("missing") == F.col("value").isNotNull()),
        astray(provenance, datasets, "dataset_id", "UNKNOWN_DATASET"),
        _codes(provenance, "artifact_id", PROVENANCE_INCOMPLETE=blank("source") | F.col("retrieved_at").isNull()),
        astray(datasets, provenance, "dataset_id", "DATASET_WITHOUT_PROVENANCE"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def validate_provenance(datasets: DataFrame, provenance: DataFrame) -> DataFrame:
    """(artifact_id, code): references that lead to no dataset, and datasets (artifact_id, dataset_id) without provenance."""
    lost = provenance.join(datasets, ["artifact_id", "dataset_id"], "left_anti").select("artifact_id", F.lit("UNKNOWN_DATASET").alias("code"))
    bare = datasets.join(provenance, ["artifact_id", "dataset_id"], "left_anti").select("artifact_id", F.lit("DATASET_WITHOUT_PROVENANCE").alias("code"))
    return lost.unionByName(bare).distinct()


def _first_day(label: Column, basis: Column, step: int) -> Column:
    """The first day of a window's label, or of the window ``step`` later; NULL for other labels and bases."""
    known = lambda b: calendar_index(label, b).isNotNull()
    year = F.make_date(calendar_index(label, "calendar-year") + step, F.lit(1), F.lit(1))
    month = F.add_months(F.when(known("calendar-month"), F.concat(label, F.lit("-01"))).cast("date"), step)
    day = F.date_add(F.when(known("calendar-day"), label).cast("date"), step)
    return F.when(basis == "calendar-year", year).when(basis == "calendar-month", month).when(basis == "calendar-day", day)


def validate_temporal(results: DataFrame, headers: DataFrame) -> DataFrame:
    """(artifact_id, idx, code) of results (artifact_id, idx, observed_at, geography, origin, value_basis, metric_version, basis,
    start, finish) against their artifact's period (artifact_id, artifact_basis, low, high); labels are inclusive.

    A result without any of the first four has no temporal metadata and is not judged. A blank basis is the artifact's. Labels
    that are no window of their basis, unknown bases and reversed periods are BAD_LABEL; a whole period has to lie inside the
    artifact's, whatever the two bases.
    """
    rows = results.join(headers, "artifact_id").filter(F.coalesce(*[F.col(c).cast("string") for c in ("observed_at", "geography", "origin", "value_basis")]).isNotNull())
    basis = F.when(blank("basis"), F.col("artifact_basis")).otherwise(F.col("basis"))
    rows = rows.withColumns({"s": _first_day(F.col("start"), basis, 0), "last": _first_day(F.col("finish"), basis, 0), "e": _first_day(F.col("finish"), basis, 1), "from": _first_day(F.col("low"), F.col("artifact_basis"), 0), "to": _first_day(F.col("high"), F.col("artifact_basis"), 1)})
    return _codes(
        rows,
        "artifact_id",
        "idx",
        OBSERVED_AT_REQUIRED=blank("observed_at"),
        GEOGRAPHY_REQUIRED=blank("geography"),
        UNKNOWN_ORIGIN=~F.col("origin").isin(*ORIGINS),
        UNKNOWN_VALUE_BASIS=~F.col("value_basis").isin(*VALUE_BASES),
        METRIC_VERSION_REQUIRED=blank("metric_version"),
        BAD_LABEL=F.col("s").isNull() | F.col("e").isNull() | F.col("from").isNull() | F.col("to").isNull() | (F.col("last") < F.col("s")),
        OUTSIDE_WINDOW=F.coalesce((F.col("s") < F.col("from")) | (F.col("e") > F.col("to")), F.lit(False)),
    )


def artifact_conflicts(artifacts: DataFrame) -> DataFrame:
    """Per id: DUPLICATE (one hash, several rows) or CONFLICT (several hashes, whatever their letters' case)."""
    rows = artifacts.groupBy("artifact_id").agg(F.count("*").alias("n"), F.count_distinct(F.lower("artifact_hash")).alias("hashes"))
    return rows.filter("n > 1").select("artifact_id", "n", F.when(F.col("hashes") > 1, "CONFLICT").otherwise("DUPLICATE").alias("kind"))


def reproducibility_key(parts: DataFrame) -> DataFrame:
    """(artifact_id, key): SHA-256 over the specification and the sorted parts (kind, value), their order ignored."""
    return parts.groupBy("artifact_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", "value"))), "\u001f").cast("binary"), 256).alias("key"))


def result_statements(results: DataFrame, metrics: DataFrame, run: str) -> DataFrame:
    """One neutral statement a result, with an id bound to the run: statement_id, idx, statement."""
    rows = results.join(metrics, "metric_id")
    text = F.concat(F.col("name"), F.lit(" = "), F.coalesce(F.col("value").cast("decimal(30,2)").cast("string"), F.lit("unknown")), F.lit(" "), F.col("unit"), F.lit(" for "), F.col("period"), F.lit(" ("), F.col("dims"), F.lit(")"))
    return rows.select(F.sha2(F.concat_ws("|", F.lit(run), "metric_id", "period", "dims").cast("binary"), 256).alias("statement_id"), "metric_id", "period", "dims", text.alias("statement"))


def artifact_document(statements: DataFrame) -> DataFrame:
    """One document an artifact (metric_id): its lines in result order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("period", "dims", "statement"))), lambda x: x["statement"])
    return statements.groupBy("metric_id").agg(F.array_join(lines, "\n").alias("content"), F.count("*").alias("lines"))


def _found(reports: pa.Table, phrases: pa.Table) -> pa.Table:
    """The phrases of a shard inside a part of its case's reports, by one pass of an automaton over each text."""
    automaton = ahocorasick.Automaton()
    for phrase in phrases.column("phrase").to_pylist():
        automaton.add_word(phrase, phrase)
    ids, held = [], []
    if len(automaton) and reports.num_rows:
        automaton.make_automaton()
        for i, text in enumerate(reports.column("text").to_pylist()):
            own = {phrase for _, phrase in automaton.iter(text)}
            ids += [i] * len(own)
            held += own
    return pa.table({"id": reports.column("id").take(pa.array(ids, pa.int64())), "phrase": pa.array(held, pa.string())})


def forbidden_phrases(reports: DataFrame, phrases: DataFrame, *, part: int = REPORTS_A_PART, shard: int = PHRASES_A_SHARD) -> DataFrame:
    """(id, phrase): the phrases (case_id, phrase) that stand anywhere in a report (id, case_id, text) of their case, once a
    report. Null and empty phrases and texts hold nothing; repeated phrases count once, repeated reports each for itself.

    A case's phrases are dealt to shards of about ``shard`` and its reports to parts of about ``part``. Each part meets each
    shard once, in an automaton that finds all phrases in one pass over a text, so work grows with the texts and the phrases
    and not with their pairs, and a case of any size is dealt to many tasks.
    """
    words = phrases.select("case_id", F.col("phrase").cast("string").alias("phrase")).filter("phrase <> ''").distinct()
    texts = reports.select("id", "case_id", F.col("text").cast("string").alias("text")).filter("text <> ''")
    share = lambda rows, name, most: rows.groupBy("case_id").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = share(words, "shards", shard).join(share(texts, "parts", part), "case_id")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = texts.join(sizes, "case_id").withColumn("part", F.pmod(F.xxhash64("id", "text"), F.col("parts")).cast("int")).withColumn("shard", every("shards")).select("case_id", "part", "shard", "id", "text")
    right = words.join(sizes, "case_id").withColumn("shard", F.pmod(F.xxhash64("phrase"), F.col("shards")).cast("int")).withColumn("part", every("parts")).select("case_id", "part", "shard", "phrase")
    keys = ["case_id", "part", "shard"]
    schema = T.StructType([T.StructField("id", reports.schema["id"].dataType), T.StructField("phrase", T.StringType())])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_found, schema)
