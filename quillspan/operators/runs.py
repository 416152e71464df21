"""Comparison of runs, matching of findings, timelines, and reads over persisted tables.

Fingerprints ignore order and ids. Greedy matching is done in rounds of locally best pairs, which the total order of pairs
makes equal to a greedy walk; each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.places import placed
from quillspan.functions.shared import shared_dir, written


def input_fingerprint(docs: DataFrame) -> DataFrame:
    """(run, documents, fingerprint) of documents (run, source, text, metadata), whatever their order: SHA-256 over the count
    and the sums of the rows' hashes, in four parts of 60 bits, so no run's documents meet in a list."""
    row = F.sha2(F.concat_ws("\u001f", F.coalesce("source", F.lit("")), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), F.coalesce("metadata", F.lit(""))).cast("binary"), 256)
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = docs.select("run", row.alias("h")).groupBy("run").agg(F.count("*").alias("documents"), *[part(k).alias(f"s{k}") for k in range(4)])
    return sums.select("run", "documents", F.sha2(F.concat_ws(",", F.col("documents").cast("string"), *[f"s{k}" for k in range(4)]).cast("binary"), 256).alias("fingerprint"))


def axis(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), "UNKNOWN").when(a == b, "SAME").otherwise("CHANGED")


def axis_attribution(pairs: DataFrame) -> DataFrame:
    """Pairs (id, a_input, b_input, a_execution, b_execution): each axis and what a difference can be attributed to."""
    i, e = axis(F.col("a_input"), F.col("b_input")), axis(F.col("a_execution"), F.col("b_execution"))
    label = F.when((i == "UNKNOWN") | (e == "UNKNOWN"), "UNKNOWN").when((i == "SAME") & (e == "SAME"), "REPEAT").when(e == "SAME", "INPUT").when(i == "SAME", "EXECUTION").otherwise("BOTH")
    return pairs.select("id", i.alias("input_axis"), e.alias("execution_axis"), label.alias("attribution"))


def set_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of only one side: ``key``, change ADDED or REMOVED."""
    gone = a.select(key).distinct().join(b, key, "left_anti").withColumn("change", F.lit("REMOVED"))
    return b.select(key).distinct().join(a, key, "left_anti").withColumn("change", F.lit("ADDED")).unionByName(gone)


def flat_fields(objects: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(``keys``, field, value) of the JSON objects in ``column``, nested objects as dotted fields, whatever their depth.

    One round opens the objects of one level; rounds are written, and end when no object is left. A value is a text: a string
    as it is, anything else as JSON, with the keys of objects inside arrays in order, so the order of keys never counts. Fields
    that hold null or an empty object, and texts that are no object or repeat a key, give no row.
    """
    inner = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    level = objects.select(*keys, F.lit("").alias("field"), inner(F.try_parse_json(column)).alias("inner"))
    done = None
    while True:
        parts = level.select(*keys, "field", F.explode("inner").alias("name", "own"))
        named = parts.select(*keys, F.concat("field", F.when(F.col("field") != "", ".").otherwise(""), "name").alias("field"), F.try_variant_get("own", "$", "string").alias("text"), inner(F.col("own")).alias("inner"))
        rows = written(named.select(*keys, "field", F.when(F.col("inner").isNull(), F.col("text")).alias("value"), F.when(F.col("inner").isNotNull(), F.col("text")).alias("object")), "json-level")
        found = rows.filter("value is not null").select(*keys, "field", "value")
        done = found if done is None else done.unionByName(found)
        level = rows.filter("object is not null").select(*keys, "field", inner(F.try_parse_json("object")).alias("inner"))
        if rows.filter("object is not null").isEmpty():
            return done


def config_field_diff(pairs: DataFrame) -> DataFrame:
    """Pairs (id, a, b) of JSON objects to the fields that differ, nested ones by their dotted names at any depth, so the
    order of keys never counts; absent is empty: id, field, a_value, b_value. See ``flat_fields``."""
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("json")) for c in ("a", "b")])
    flat = flat_fields(pairs.select("id", F.explode(sides).alias("own")).select("id", "own.side", "own.json"), ["id", "side"], "json")
    return _differing(flat, "id")


def _differing(flat: DataFrame, *keys: str) -> DataFrame:
    """The fields of sides a and b (keys, side, field, value) that differ; absent is empty."""
    value = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("value"))), F.lit("")).alias(f"{side}_value")
    return flat.groupBy(*keys, "field").agg(value("a"), value("b")).filter("a_value <> b_value")


def numeric_metrics(runs: DataFrame) -> DataFrame:
    """(run, metric, value) of the numbers at the top level of each run's JSON object ``metrics``; texts, flags, nulls, arrays
    and objects are no metrics."""
    rows = runs.select("run", F.explode(F.try_variant_get(F.try_parse_json("metrics"), "$", "map<string,variant>")).alias("metric", "own"))
    return rows.filter(F.to_json("own").rlike("^-?[0-9]")).select("run", "metric", F.try_variant_get("own", "$", "double").alias("value"))


def metric_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metrics (metric, value) of two runs with b - a where both exist."""
    both = a.select("metric", F.col("value").alias("a_value")).join(b.select("metric", F.col("value").alias("b_value")), "metric", "full")
    return both.select("metric", "a_value", "b_value", F.round(F.col("b_value") - F.col("a_value"), 6).alias("delta"))


def repeat_groups(runs: DataFrame) -> DataFrame:
    """Completed runs (run, input, execution, metric, value) with equal prints: runs, low, high, whether variation is known."""
    return runs.filter("input is not null and execution is not null").groupBy("input", "execution", "metric").agg(F.count_distinct("run").alias("runs"), F.min("value").alias("low"), F.max("value").alias("high"), (F.count_distinct("run") >= 2).alias("variation_known"))


def merge_spans(spans: DataFrame, *keys: str) -> DataFrame:
    """Spans (keys, start, end) as disjoint ones: gaps and islands by the furthest end so far."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", (F.col("start") > F.coalesce(reach, F.lit(-1))).cast("int")).withColumn("island", F.sum("new").over(w))
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


CELL = 256  # characters of a stretch in which spans meet


def span_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per pair of findings (doc_id, finding, start, end on both sides) that share characters of a document: covered
    characters in common over those covered by either, to three places. Spans are merged first, so no character counts
    twice, and cut at stretches of ``CELL`` characters, so only spans of one stretch meet."""
    ma, mb = (merge_spans(side.filter("start < end"), "finding", "doc_id") for side in (a, b))  # empty spans cover nothing

    def pieces(m: DataFrame, name: str, s: str, e: str) -> DataFrame:
        # A finding's size goes with its spans, of which there are far fewer than pairs: pairs are shuffled once only.
        sized = m.join(m.groupBy("finding").agg(F.sum(F.col("end") - F.col("start")).alias("n")), "finding")
        cells = sized.withColumn("cell", F.explode(F.expr(f"sequence(start div {CELL}, (end - 1) div {CELL})")))
        return cells.select(F.struct(F.col("finding").alias("id"), "n").alias(name), "doc_id", "cell", F.greatest("start", F.col("cell") * CELL).alias(s), F.least("end", (F.col("cell") + 1) * CELL).alias(e))

    met = pieces(ma, "a", "s", "e").join(pieces(mb, "b", "t", "f"), ["doc_id", "cell"]).filter("s < f and t < e")
    each = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), (F.least("e", "f") - F.greatest("s", "t")).alias("common"))
    # Few pairs meet twice, so adding them up before the shuffle would only fill the memory.
    sums = each.repartition("a", "b").groupBy("a", "b").agg(F.sum("common").alias("common"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return sums.select("a", "b", F.round(F.try_divide("common", F.col("na") + F.col("nb") - F.col("common")), 3).alias("overlap"))


def span_list(spans: DataFrame) -> DataFrame:
    """(finding, spans): a hash of each finding's spans in order, empty ones left out."""
    own = spans.filter("start < end").groupBy("finding").agg(F.array_sort(F.collect_list(F.struct("doc_id", "start", "end"))).alias("spans"))
    return own.select("finding", F.sha2(F.to_json("spans").cast("binary"), 256).alias("spans"))


def match_pairs(candidates: DataFrame) -> DataFrame:
    """A greedy one-to-one matching of candidates (a, b, score): best score first, then smaller a, then smaller b.

    A pair that is the best of both its sides is what a greedy walk takes, so each round takes all of these at once. The
    best pair of all is one of them, so the rounds end when no candidate is left. Candidates without a or b match nothing.
    """
    context = candidates.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(candidates.sparkSession))
    left = candidates.filter("a is not null and b is not null").groupBy("a", "b").agg(F.max("score").alias("score")).checkpoint()
    taken, rounds = left.limit(0), 0
    order = [F.desc("score"), "a", "b"]
    while not left.isEmpty():
        best = left.withColumn("ra", F.row_number().over(Window.partitionBy("a").orderBy(*order))).withColumn("rb", F.row_number().over(Window.partitionBy("b").orderBy(*order))).filter("ra = 1 and rb = 1").select("a", "b", "score").checkpoint()
        taken, rounds = taken.unionByName(best), rounds + 1
        if rounds % 20 == 0:  # a union of very many rounds is slow to plan
            taken = taken.coalesce(context.defaultParallelism).checkpoint()
        left = left.join(best.select("a"), "a", "left_anti").join(best.select("b"), "b", "left_anti").select("a", "b", "score").checkpoint()
    return taken


def match_titles(titles_a: DataFrame, titles_b: DataFrame) -> DataFrame:
    """A greedy matching (a, b) of findings (finding, title) of equal title, smaller a first, then smaller b: the n-th of
    one side with the n-th of the other, so no pairs are tried. Only findings of several titles need the rounds."""
    one, other = (t.select("finding", "title").dropna().distinct() for t in (titles_a, titles_b))
    several = lambda t: not t.groupBy("finding").count().filter("count > 1").isEmpty()
    x, y = one.withColumnRenamed("finding", "a"), other.withColumnRenamed("finding", "b")
    if several(one) or several(other):
        return match_pairs(x.join(y, "title").select("a", "b", F.lit(0.5).alias("score"))).select("a", "b")
    nth = lambda t, c: t.withColumn("n", F.row_number().over(Window.partitionBy("title").orderBy(c)))
    return nth(x, "a").join(nth(y, "b"), ["title", "n"]).select("a", "b")


#: Names of the ways to match, best first.
EXACT, OVERLAP, TITLE = "EXACT_EVIDENCE_SPANS", "EVIDENCE_SPAN_OVERLAP", "HYPOTHESIS_COMPARISON_KEY"


def match_findings(spans_a: DataFrame, spans_b: DataFrame, titles_a: DataFrame, titles_b: DataFrame, least: float = 0.3) -> DataFrame:
    """Findings of two runs matched by equal lists of spans (score 1), overlap of ``least`` or more (its share) or equal title
    (score 0.5): a, b, method, score. A better method goes before a better score, so titles match what the spans leave."""
    same = span_list(spans_a).withColumnRenamed("finding", "a").join(span_list(spans_b).withColumnRenamed("finding", "b"), "spans").select("a", "b")
    over = span_overlap(spans_a, spans_b).filter(F.col("overlap") >= least).select("a", "b", (1 + F.col("overlap")).alias("score"))
    found = match_pairs(over.unionByName(same.select("a", "b", F.lit(3.0).alias("score"))))
    rest = lambda titles, side: titles.join(found.select(F.col(side).alias("finding")), "finding", "left_anti")
    title = match_titles(rest(titles_a, "a"), rest(titles_b, "b"))
    exact = F.col("score") == 3
    by_span = found.select("a", "b", F.when(exact, EXACT).otherwise(OVERLAP).alias("method"), F.when(exact, 1.0).otherwise(F.round(F.col("score") - 1, 3)).alias("score"))
    return by_span.unionByName(title.select("a", "b", F.lit(TITLE).alias("method"), F.lit(0.5).alias("score")))


def finding_changes(matches: DataFrame, findings_a: DataFrame, findings_b: DataFrame, fields: list[str]) -> DataFrame:
    """Matches (a, b, method, score) with ``changed``, the names of the ``fields`` that differ, and a row for each finding
    (finding and the fields) of one side only: ADDED has no a, REMOVED no b."""
    a = findings_a.select(F.col("finding").alias("a"), F.struct(*fields).alias("x"))
    b = findings_b.select(F.col("finding").alias("b"), F.struct(*fields).alias("y"))
    both = matches.join(a, "a").join(b, "b")
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    changed = F.concat_ws(",", *[F.when(empty(F.col("x")[f]) != empty(F.col("y")[f]), f) for f in sorted(fields)])
    out = both.select("a", "b", "method", "score", changed.alias("changed"))
    gone = a.join(matches, "a", "left_anti").select("a", F.lit("REMOVED").alias("method"))
    new = b.join(matches, "b", "left_anti").select("b", F.lit("ADDED").alias("method"))
    return out.unionByName(gone, allowMissingColumns=True).unionByName(new, allowMissingColumns=True)


def metrics_history(runs: DataFrame) -> DataFrame:
    """Runs oldest first: project, pos, run, and their metric only where completed."""
    ranked = placed(runs, ["project"], [F.to_date("created_at")], ["created_at", "run"])
    return ranked.select("project", "pos", "run", F.when(F.col("status") == "COMPLETED", F.col("metric")).alias("metric"))


def latest_completed_run(runs: DataFrame) -> DataFrame:
    """The newest completed run of each project: latest finish, then latest creation, then greatest id."""
    return runs.filter("status = 'COMPLETED'").groupBy("project").agg(F.max_by("run", F.struct("finished_at", "created_at", "run")).alias("run"))


def evidence_events(iterations: DataFrame, declared: DataFrame, added: DataFrame, documents: DataFrame) -> DataFrame:
    """ADDED, REMOVED, CONTENT_CHANGED and DEFINITION_CHANGED: run, seq, ref, event.

    ``iterations``: run, seq, analysis. ``declared`` and ``added``: run, seq, ref. ``documents``: analysis, ref, hash, definition.
    References are trimmed, blank ones dropped. A reference is added when it is declared or added and not yet seen. It is
    removed when the iteration before declared it and this one declares others but not it; evidence that was only added is
    never removed, and an iteration that declares nothing removes nothing. One that comes back after its removal is added
    again. Between consecutive iterations of different analyses, a document in both has other content, or else another
    definition; a missing hash is a value of its own.

    A reference's mentions and removals are its gaps and islands: an ADDED is a mention whose last event is none or a removal.
    There is a row for each mention and removal, none for iterations in between.
    """
    order = Window.partitionBy("run").orderBy("seq")
    steps = iterations.groupBy("run", "seq").agg(F.max("analysis").alias("analysis"))
    steps = steps.withColumns({"next": F.lead("seq").over(order), "next_analysis": F.lead("analysis").over(order)})
    named = lambda refs: refs.select("run", "seq", F.trim(F.col("ref").cast("string")).alias("ref")).filter("ref <> ''").distinct()
    full = named(declared).join(steps.select("run", "seq", "next"), ["run", "seq"])
    given = full.select("run", "seq").distinct()
    current = full.select("run", F.col("seq").alias("next"), "ref")
    gone = full.join(given.withColumnRenamed("seq", "next"), ["run", "next"], "left_semi").join(current, ["run", "next", "ref"], "left_anti").select("run", F.col("next").alias("seq"), "ref", F.lit(1).alias("kind"))
    here = full.select("run", "seq", "ref").unionByName(named(added).join(steps.select("run", "seq"), ["run", "seq"], "left_semi")).distinct().withColumn("kind", F.lit(0))
    last = F.lag("kind", 1, 1).over(Window.partitionBy("run", "ref").orderBy("seq", "kind"))
    event = F.when(F.col("kind") == 1, "REMOVED").when(F.col("last") == 1, "ADDED")
    presence = here.unionByName(gone).withColumn("last", last).select("run", "seq", "ref", event.alias("event")).filter("event is not null")
    docs = documents.select("analysis", F.trim(F.col("ref").cast("string")).alias("ref"), "hash", "definition")
    turned = steps.filter("analysis <> next_analysis").select("run", F.col("next").alias("seq"), "analysis", "next_analysis")
    after = docs.select(F.col("analysis").alias("next_analysis"), "ref", F.col("hash").alias("now_hash"), F.col("definition").alias("now_definition"))
    pairs = turned.join(docs, "analysis").join(after, ["next_analysis", "ref"])
    change = F.when(~F.col("hash").eqNullSafe(F.col("now_hash")), "CONTENT_CHANGED").when(~F.col("definition").eqNullSafe(F.col("now_definition")), "DEFINITION_CHANGED")
    return presence.unionByName(pairs.select("run", "seq", "ref", change.alias("event")).filter("event is not null"))


def instrument_changes(configs: DataFrame) -> DataFrame:
    """Fields that changed between consecutive iterations' configurations (run, seq, config JSON)."""
    order = Window.partitionBy("run").orderBy("seq")
    rows = configs.select("run", "seq", "config", F.lead(F.struct("seq")).over(order).alias("next"), F.lag(F.col("config").isNotNull(), 1, False).over(order).alias("follows"))
    # Each configuration is opened once: it is the later side of its own step and the earlier side of the next.
    flat = flat_fields(rows, ["run", "seq", "next", "follows"], "config")
    now = flat.filter("follows").select("run", "seq", F.lit("b").alias("side"), "field", "value")
    before = flat.filter("next is not null").select("run", F.col("next.seq").alias("seq"), F.lit("a").alias("side"), "field", "value")
    return _differing(now.unionByName(before), "run", "seq")


def change_attribution(changes: DataFrame, evidence: DataFrame, instruments: DataFrame) -> DataFrame:
    """Changes (run, seq, key, change) with what came with them: EVIDENCE, INSTRUMENT, BOTH or NONE, and whether an earlier
    reading is invalid."""
    e = evidence.select("run", "seq", F.lit(True).alias("e")).distinct()
    i = instruments.select("run", "seq", F.lit(True).alias("i")).distinct()
    rows = changes.join(e, ["run", "seq"], "left").join(i, ["run", "seq"], "left")
    label = F.when(F.col("e") & F.col("i"), "BOTH").when(F.col("e"), "EVIDENCE").when(F.col("i"), "INSTRUMENT").otherwise("NONE")
    return rows.select("run", "seq", "key", "change", label.alias("attribution"), F.col("change").isin("WEAKENED", "CONTRADICTED").alias("invalidates"))


def uncertainty_carry(statements: DataFrame) -> DataFrame:
    """"Cannot conclude" statements (run, seq, statement) carried from the iteration before, or resolved since."""
    before = statements.select("run", (F.col("seq") + 1).alias("seq"), "statement", F.lit(True).alias("b")).distinct()
    now = statements.select("run", "seq", "statement", F.lit(True).alias("n")).distinct()
    known = now.select("run", "seq").distinct()
    rows = before.join(known, ["run", "seq"], "left_semi").join(now, ["run", "seq", "statement"], "left")
    return rows.select("run", "seq", "statement", F.when(F.col("n"), "CARRIED").otherwise("RESOLVED").alias("state"))


def iteration_run(findings: DataFrame) -> DataFrame:
    """The one run that an iteration's findings (iteration, run) agree on; mixed ones are an error, none recorded is NULL."""
    rows = findings.groupBy("iteration").agg(F.count_distinct("run").alias("n"), F.min("run").alias("run"))
    return rows.select("iteration", F.when(F.col("n") == 1, F.col("run")).alias("run"), F.when(F.col("n") > 1, "MIXED_RUNS").alias("error"))


def reevaluation_gate(pairs: DataFrame) -> DataFrame:
    """(id, proceed, reason): known and equal prints before and after mean that no evidence changed."""
    same = F.coalesce(F.col("before") == F.col("after"), F.lit(False))
    return pairs.select("id", (~same).alias("proceed"), F.when(same, "NO_EVIDENCE_CHANGE").alias("reason"))


def timeline_events(changes: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Hypothesis changes (run, at, what) and scenario evaluations in one timeline: run, pos, at, kind, what."""
    rows = changes.select("run", "at", F.lit("HYPOTHESIS").alias("kind"), "what").unionByName(evaluations.select("run", "at", F.lit("SCENARIO").alias("kind"), "what"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("run").orderBy("at", "kind", "what"))).select("run", "pos", "at", "kind", "what")


# -- reads over persisted tables ----------------------------------------------------------------------------------------


def observations_by_project(observations: DataFrame, documents: DataFrame) -> DataFrame:
    """Observations (id, doc_id, created_at) with their document's project and place in it."""
    rows = observations.join(documents.select("doc_id", "project"), "doc_id")
    return placed(rows, ["project"], [F.to_date("created_at")], ["created_at", "id"]).select("project", "pos", "id", "doc_id")


def patterns_ranked(patterns: DataFrame, links: DataFrame) -> DataFrame:
    """Patterns (id, project, kind, created_at), deviations first, then by time, with their observation ids."""
    ids = links.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("observation_id")), lambda x: x.cast("string")), ",").alias("observations"))
    ranked = placed(patterns, ["project"], [F.when(F.col("kind") == "deviation", 0).otherwise(1), F.to_date("created_at")], ["created_at", "id"])
    return ranked.join(ids, "id", "left").select("project", "pos", "id", "kind", F.coalesce("observations", F.lit("")).alias("observations"))


def patterns_of_finding(findings: DataFrame, links: DataFrame, patterns: DataFrame) -> DataFrame:
    """(finding_id, id, kind) by the link table."""
    return findings.select("finding_id").join(links, "finding_id").join(patterns.select("id", "kind"), "id").select("finding_id", "id", "kind")


def evidence_count_by_project(evidence: DataFrame, findings: DataFrame) -> DataFrame:
    return evidence.join(findings, "finding_id").groupBy("project").agg(F.count("*").alias("evidence"))


def evidence_ranked(evidence: DataFrame, top: int | None = None) -> DataFrame:
    """Evidence (finding_id, id, relevance) of each finding by falling relevance; the first ``top`` only, if given."""
    rows = evidence.withColumn("rank", F.row_number().over(Window.partitionBy("finding_id").orderBy(F.desc("relevance"), "id"))).select("finding_id", "rank", "id", "relevance")
    return rows if top is None else rows.filter(F.col("rank") <= top)


def backfill_observation_run(links: DataFrame) -> DataFrame:
    """The run of each observation whose links (id, run) agree on exactly one."""
    return links.groupBy("id").agg(F.count_distinct("run").alias("n"), F.min("run").alias("run")).filter("n = 1").select("id", "run")
