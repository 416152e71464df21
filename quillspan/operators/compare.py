"""Comparison of observations, datasets and reports. Incomparable inputs suppress arithmetic and say why.

Lists of codes are texts joined by commas, in the order of the rules. NULL inputs give NULL values with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that must be equal for arithmetic, with the code of a difference, in order.
INCOMPATIBLE = (
    ("metric_id", "INCOMPATIBLE_METRIC"),
    ("population", "INCOMPATIBLE_POPULATION"),
    ("filters", "INCOMPATIBLE_FILTERS"),
    ("parameters", "INCOMPATIBLE_PARAMETERS"),
    ("spec_hash", "INCOMPATIBLE_SPEC"),
    ("geography", "INCOMPATIBLE_GEOGRAPHY"),
    ("value_basis", "INCOMPATIBLE_VALUE_BASIS"),
    ("origin", "INCOMPATIBLE_ORIGIN"),
    ("dims", "INCOMPATIBLE_DIMENSIONS"),
)
PERIOD = ("basis", "start", "end", "windows")
#: Fields of an observation that are checked where a table has them.
OWN = ("id", "analysis", "metric_version", "result_metric", "observed_at")
#: Where a value comes from, and what it is measured in.
ORIGINS, VALUE_BASES = ("observed", "derived"), ("nominal", "real", "not_applicable")
#: How a dataset may have been retrieved, and names of parameters that carry a secret.
METHODS = ("api", "download", "manual_export", "fixture", "user_provided")
CREDENTIALS = r"(?i)(^id$|app_?id|api_?key|key$|token|secret|passw|credential|authorization|signature)"


def _codes(*codes: Column) -> Column:
    return F.concat_ws(",", *codes)


def _same_json(a: Column, b: Column) -> Column:
    """Equal as JSON, whatever the order of keys; texts that are no JSON are compared as they are."""
    plain = lambda c: F.coalesce(F.to_json(F.try_parse_json(c)), c)
    return plain(a).eqNullSafe(plain(b))


def _pair_warnings(p: Column, c: Column, has: set[str]) -> list[Column]:
    """The codes of a pair, in order; rules about fields that the structs do not have are passed over."""
    blank = lambda s, f: F.coalesce(F.trim(s[f].cast("string")), F.lit("")) == ""
    either = lambda rule: rule(p) | rule(c)
    no = F.lit(False)
    lacks = lambda f: either(lambda s: blank(s, f)) if f in has else no
    bare = lambda s: s["geography"].isNull() & s["value_basis"].isNull() & s["origin"].isNull()
    odd = lambda s: blank(s, "geography") | ~F.coalesce(s["origin"].isin(*ORIGINS), no) | ~F.coalesce(s["value_basis"].isin(*VALUE_BASES), no)
    unrecorded = either(bare)
    versions = (~p["metric_version"].eqNullSafe(c["metric_version"]) | lacks("metric_version")) if "metric_version" in has else no
    differs = {f: ~p[f].eqNullSafe(c[f]) for f, _ in INCOMPATIBLE}
    differs |= {"metric_id": differs["metric_id"] | versions, "filters": ~_same_json(p["filters"], c["filters"])} | {f: ~unrecorded & differs[f] for f in ("geography", "value_basis", "origin")}
    codes = {f: F.when(differs[f], code) for f, code in INCOMPATIBLE}
    ordered = (p["basis"] == c["basis"]) & (p["windows"] == c["windows"]) & (c["start"] >= p["end"]) & (c["start"] > p["start"])
    invalid = either(odd) | lacks("observed_at")
    return [
        F.when(lacks("id") | lacks("analysis"), "UNKNOWN_OBSERVATION_OWNERSHIP"),
        F.when(either(lambda s: blank(s, "source")), "INVALID_PROVENANCE"),
        *[codes[f] for f in ("metric_id", "population", "filters", "parameters", "spec_hash")],
        F.when(unrecorded, "MISSING_TEMPORAL_METADATA"),
        *[codes[f] for f in ("geography", "value_basis", "origin")],
        F.when(~unrecorded & invalid, "INVALID_TEMPORAL_EVIDENCE"),
        codes["dims"],
        F.when(~F.coalesce(ordered, no), "INCOMPATIBLE_PERIOD"),
        F.when(either(lambda s: ~s["result_metric"].eqNullSafe(s["metric_id"])) if "result_metric" in has else no, "INVALID_METRIC_REFERENCE"),
        F.when(p["value"].isNull() | c["value"].isNull(), "MISSING_OR_NON_NUMERIC_VALUE"),
    ]


def compare_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of structs ``prev`` and ``cur`` (fields of ``INCOMPATIBLE``, basis, start, end, windows, value, source, flagged, and
    any of ``OWN``) with absolute and relative change, direction, warnings. Any warning suppresses arithmetic; ``review`` codes
    do not.

    A side that is NULL has no temporal evidence, and no other code is given. One without geography, basis and origin has no
    temporal metadata: these are then not compared, as an unknown is never equal to another. Filters are JSON. Periods must
    share a calendar basis and a number of windows, and follow each other without overlap; ``end`` is the first day after the
    period. A side without a source has no provenance.
    """
    p, c = F.col("prev"), F.col("cur")
    known = p.isNotNull() & c.isNotNull()
    codes = _pair_warnings(p, c, set(pairs.schema["prev"].dataType.names))
    warnings = F.when(known, _codes(*codes)).otherwise("MISSING_TEMPORAL_EVIDENCE")
    ok = warnings == ""
    change = F.when(ok, c["value"] - p["value"])
    finite = ~(F.isnan(change) | (F.abs(change) == float("inf")))
    warnings = F.when(ok & ~finite, "NON_FINITE_DELTA").otherwise(warnings)
    change = F.when(finite, change)
    review = F.when(ok & finite, _codes(F.when(p["value"] == 0, "ZERO_BASELINE"), F.when(~p["source"].eqNullSafe(c["source"]), "SOURCE_CHANGED"), F.when(p["flagged"] | c["flagged"], "QUALITY_FLAGS_PRESENT"))).otherwise("")
    direction = F.when(change > 0, "increase").when(change < 0, "decrease").when(change == 0, "unchanged").otherwise("unknown")
    return pairs.select("*", F.round(change, 4).alias("absolute"), F.round(F.try_divide(change, F.abs(p["value"])), 9).alias("relative"), direction.alias("direction"), warnings.alias("warnings"), review.alias("review"))


def compare_series(observations: DataFrame, group: str, order: str) -> DataFrame:
    """Adjacent pairs of each group in the caller's order, never sorted otherwise."""
    fields = [*[f for f, _ in INCOMPATIBLE], *PERIOD, "value", "source", "flagged", *[f for f in OWN if f in observations.columns]]
    rows = observations.select(group, order, F.struct(*fields).alias("cur")).withColumn("prev", F.lag("cur").over(Window.partitionBy(group).orderBy(order)))
    return compare_pairs(rows.filter("prev is not null"))


def collapse_copies(docs: DataFrame) -> DataFrame:
    """Documents (id, source, content, metadata) with kept_id: the smallest id of those with the same source, content and
    metadata, by hashes, so no text is shuffled twice."""
    key = [F.coalesce("source", F.lit("")), F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256), F.coalesce("metadata", F.lit(""))]
    keyed = docs.select("id", F.sha2(F.concat_ws("\u001f", *key).cast("binary"), 256).alias("key"))
    first = keyed.groupBy("key").agg(F.min("id").alias("kept_id"), F.count("*").alias("copies"))
    return keyed.join(first, "key").select("id", "kept_id", "copies", (F.col("id") == F.col("kept_id")).alias("kept"))


def dataset_observations(docs: DataFrame) -> DataFrame:
    """Documents (id, content, record_count text) as observations: the count and the first sentence; bad counts are noted."""
    good = F.col("record_count").rlike(r"^[0-9]{1,18}$")
    return docs.select("id", F.when(good, F.col("record_count").try_cast("bigint")).alias("value"), F.when(good, F.regexp_extract("content", r"(?s)^(.*?[.])", 1)).alias("quote"), F.when(~F.coalesce(good, F.lit(False)), "BAD_RECORD_COUNT").alias("note"))


def dataset_comparisons(points: DataFrame) -> DataFrame:
    """Per series (series, period, value): change from the period before and from the first, rate, share of the total.

    A series with a repeated period is skipped: one row with the note DUPLICATE_PERIOD.
    """
    repeats = points.groupBy("series", "period").agg(F.count("*").alias("n")).filter("n > 1").select("series").distinct()
    w, whole = Window.partitionBy("series").orderBy("period"), Window.partitionBy("series")
    prev, first = F.lag("value").over(w), F.first("value").over(w)
    good = points.join(repeats, "series", "left_anti").select(
        "series", "period", "value", (F.col("value") - prev).alias("delta"), F.round(F.try_divide(F.col("value") - prev, prev), 9).alias("rate"), (F.col("value") - first).alias("from_baseline"), F.round(F.try_divide(F.col("value"), F.sum("value").over(whole)), 9).alias("share"), F.lit(None).cast("string").alias("note")
    )
    return good.unionByName(repeats.withColumn("note", F.lit("DUPLICATE_PERIOD")), allowMissingColumns=True)


def comparison_patterns(comparisons: DataFrame, observations: DataFrame) -> DataFrame:
    """Each comparison (series, period, prev_period, delta) with the ids of the two observations and a sentence."""
    a = observations.select("series", F.col("period").alias("prev_period"), F.col("id").alias("from_id"))
    b = observations.select("series", "period", F.col("id").alias("to_id"))
    text = F.format_string("%s changed by %d from %s to %s", "series", "delta", "prev_period", "period")
    return comparisons.join(a, ["series", "prev_period"]).join(b, ["series", "period"]).select("series", "period", "from_id", "to_id", text.alias("text"))


def granularity(period: Column) -> Column:
    """day, month or year by the first date of a period's label (2021, 2021..2024, 2026-01/2026-06); NULL for anything else."""
    first = F.trim(F.get(F.split(F.trim(period), r"\.\.|/| to |〜|~"), F.lit(0)))
    return F.when(first.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "day").when(first.rlike(r"^[0-9]{4}-[0-9]{2}$"), "month").when(first.rlike("^[0-9]{4}$"), "year")


SIGNATURE = ("unit", "population_id", "population", "granularity", "schema_id", "schema_version")


def manifest_classes(manifests: DataFrame) -> DataFrame:
    """(project, dataset_id, class, and the fields of ``SIGNATURE``): datasets of one project with equal fields are a class,
    named by its least dataset_id. Manifests: project, dataset_id, unit, population_id, population, period, schema_id,
    schema_version; units, populations and versions in lower case without outer blanks, blank ones NULL; ids as they are, and
    empty ones NULL. Of several manifests of a dataset the one with the least fields counts."""
    plain = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    fields = [plain("unit"), F.nullif(F.col("population_id"), F.lit("")), plain("population"), granularity(F.col("period")), F.coalesce("schema_id", F.lit("")), plain("schema_version")]
    one = manifests.select("project", "dataset_id", F.struct(*[f.alias(n) for f, n in zip(fields, SIGNATURE, strict=True)]).alias("own")).groupBy("project", "dataset_id").agg(F.min("own").alias("own"))
    return one.withColumn("class", F.min("dataset_id").over(Window.partitionBy("project", "own"))).select("project", "dataset_id", "class", "own.*")


def manifest_compatibility(classes: DataFrame) -> DataFrame:
    """Pairs of one project's classes (see ``manifest_classes``) with what differs: project, a, b, pairs, warnings; ``pairs`` is
    how many pairs of datasets that is. Unknown fields are no mismatch. Populations are compared by id where both have one;
    schema versions only under one schema id. Classes meet, not datasets, and pairs that agree have no row."""
    sized = classes.groupBy("project", "class", *SIGNATURE).agg(F.count("*").alias("n"))
    side = lambda name, n: sized.select("project", F.col("class").alias(name), F.col("n").alias(n), F.struct(*SIGNATURE).alias(f"of_{name}"))
    x, y = F.col("of_a"), F.col("of_b")
    other = lambda f: x[f] != y[f]
    ids = x["population_id"].isNotNull() & y["population_id"].isNotNull()
    codes = _codes(
        F.when(other("unit"), "UNIT_MISMATCH"),
        F.when(F.when(ids, other("population_id")).otherwise(other("population")), "POPULATION_MISMATCH"),
        F.when(other("granularity"), "GRANULARITY_MISMATCH"),
        F.when((x["schema_id"] == y["schema_id"]) & other("schema_version"), "SCHEMA_VERSION_MISMATCH"),
    )
    pairs = side("a", "na").join(side("b", "nb"), "project").filter("a < b")
    return pairs.select("project", "a", "b", (F.col("na") * F.col("nb")).alias("pairs"), codes.alias("warnings")).filter("warnings <> ''")


def manifest_validate(manifests: DataFrame) -> DataFrame:
    """Violations (dataset_id, code) of manifests (dataset_id, source_name, schema_id, method, retrieved_at, parameters MAP,
    url). A name that may carry a secret is one, in the map and in the URL's query."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    secret = lambda keys: F.coalesce(F.exists(keys, lambda k: k.rlike(CREDENTIALS)), F.lit(False))
    query = F.transform(F.split(F.regexp_extract("url", r"[?]([^#]*)", 1), "&"), lambda part: F.get(F.split(part, "="), F.lit(0)))
    codes = F.array_compact(
        F.array(
            F.when(blank("source_name"), "SOURCE_NAME_REQUIRED"),
            F.when(blank("dataset_id"), "DATASET_ID_REQUIRED"),
            F.when(blank("method"), "METHOD_REQUIRED").when(~F.col("method").isin(*METHODS), "UNKNOWN_METHOD"),
            F.when(blank("retrieved_at"), "RETRIEVED_AT_REQUIRED"),
            F.when(blank("schema_id"), "SCHEMA_ID_REQUIRED"),
            F.when(secret(F.map_keys("parameters")), "CREDENTIAL_PARAMETER"),
            F.when(secret(query), "CREDENTIAL_IN_URL"),
        )
    )
    return manifests.select("dataset_id", F.explode(codes).alias("code"))


def comparability_label(a_population: Column, b_population: Column, a_method: Column, b_method: Column) -> Column:
    """COMPARABLE for one population observed on both sides, HARMONIZED_REFERENCE if either was harmonised to it, else
    NOT_COMPARABLE."""
    same = a_population.eqNullSafe(b_population) & a_population.isNotNull()
    observed = (a_method == "observed") & (b_method == "observed")
    return F.when(same & observed, "COMPARABLE").when(same, "HARMONIZED_REFERENCE").otherwise("NOT_COMPARABLE")


def pct_change_report(records: DataFrame, before: str, after: str) -> DataFrame:
    """Per metric and geography, from records (metric_id, period, geography, value DECIMAL): delta and percent to one
    place, half up, both decimals.

    A side that is not exactly one record is an error, and so is a baseline of zero or a missing value. Values may have 33
    digits; the percent is worked out in whole numbers, so nothing is rounded before the last step.
    """
    side = lambda p: F.col("period") == p
    rows = records.groupBy("metric_id", "geography").agg(F.count_if(side(before)).alias("nb"), F.count_if(side(after)).alias("na"), F.max(F.when(side(before), F.col("value"))).alias("b"), F.max(F.when(side(after), F.col("value"))).alias("a"))
    error = F.when((F.col("nb") != 1) | (F.col("na") != 1), "NOT_EXACTLY_ONE_RECORD").when(F.col("a").isNull() | F.col("b").isNull(), "MISSING_VALUE").when(F.col("b") == 0, "ZERO_BASELINE")
    counted = F.col("error").isNull() | (F.col("error") == "ZERO_BASELINE")
    tenths = F.when(F.col("error").isNull(), F.expr("sign(a - b) * sign(b) * ((2000 * abs(a - b) + abs(b)) div (2 * abs(b)))"))
    percent = (tenths.cast("decimal(20,0)") / F.lit(10)).cast("decimal(21,1)")
    return rows.withColumn("error", error).select("metric_id", "geography", F.when(counted, F.col("a") - F.col("b")).alias("delta"), percent.alias("percent"), "error")


def weakest_comparability(claims: DataFrame) -> DataFrame:
    """Per claim (claim_id, stated, label of each comparison): the weakest label and whether the stated one differs."""
    rank = F.when(F.col("label") == "COMPARABLE", 2).when(F.col("label") == "HARMONIZED_REFERENCE", 1).otherwise(0)
    rows = claims.groupBy("claim_id").agg(F.min_by("label", rank).alias("weakest"), F.min("stated").alias("stated"))
    return rows.select("claim_id", "weakest", "stated", (~F.col("weakest").eqNullSafe(F.col("stated"))).alias("violation"))


def concentration_share(parts: DataFrame, wholes: DataFrame, before: str, after: str) -> DataFrame:
    """Per part (part, period, value DECIMAL) its share of wholes (period, value DECIMAL) in two periods, in percent to two
    places, half up, and the change in points: the difference of the unrounded shares, rounded once. All are decimals.

    A period without a whole, and a whole of zero, give no share."""
    rows = parts.join(wholes.select("period", F.col("value").alias("whole")), "period").withColumn("share", F.try_divide(F.col("value"), F.col("whole")))
    at = lambda p: F.max(F.when(F.col("period") == p, F.col("share")))
    two = rows.groupBy("part").agg(at(before).alias("b"), at(after).alias("a"))
    percent = lambda share: (F.round(share, 4) * 100).cast("decimal(20,2)")
    return two.select("part", percent(F.col("b")).alias("share_before"), percent(F.col("a")).alias("share_after"), percent(F.col("a") - F.col("b")).alias("points"))


def gap_decomposition(rows: DataFrame) -> DataFrame:
    """From (id, naive, excluded): within-scope change and both parts' shares of the naive difference."""
    within = F.col("naive") - F.col("excluded")
    part = lambda c: F.round(F.try_divide(c, F.col("naive")), 6)
    return rows.select("id", "naive", "excluded", within.alias("within_scope"), part(F.col("excluded")).alias("excluded_share"), part(within).alias("within_share"))


def latest_by_series(observations: DataFrame) -> DataFrame:
    """The latest observation (id, series, period_end, value) of each series: greatest period end, then greatest id."""
    return observations.groupBy("series").agg(F.max_by(F.struct("id", "period_end", "value"), F.struct("period_end", "id")).alias("last")).select("series", "last.*")


def run_observation_deltas(observations: DataFrame) -> DataFrame:
    """Between consecutive runs, per series of both (run, series, definition, period_end, value, id): RESTATED (the same period
    with another value; with the same one there is no row), else DEFINITION_CHANGED, else DELTA, with the change in value unless
    definitions differ."""
    latest = observations.groupBy("run", "series").agg(F.max_by(F.struct("id", "definition", "period_end", "value"), F.struct("period_end", "id")).alias("cur"))
    # Runs are few beside their observations; a series that skips a run has no pair there.
    steps = latest.select("run").distinct().withColumn("before", F.lag("run").over(Window.orderBy("run")))
    rows = latest.join(steps, "run").join(latest.select(F.col("run").alias("before"), "series", F.col("cur").alias("prev")), ["before", "series"])
    p, c = F.col("prev"), F.col("cur")
    same_def, same_period = p["definition"].eqNullSafe(c["definition"]), p["period_end"].eqNullSafe(c["period_end"])
    kind = F.when(same_period, F.when(~p["value"].eqNullSafe(c["value"]), "RESTATED")).when(~same_def, "DEFINITION_CHANGED").otherwise("DELTA")
    return rows.select("run", "series", kind.alias("kind"), F.when(same_def, F.round(c["value"] - p["value"], 4)).alias("delta")).filter("kind is not null")
