"""Passages, grounding of quotes and evidence scoring.

Null texts count as empty. Offsets are 0-based code points, ends exclusive. Ids never come from a clock or a random number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.places import placed
from quillspan.functions.shared import written

CHUNK, BUDGET, SEPARATOR = 8000, 64_000, 2
#: White space at the ends of a text, that beyond ASCII too.
SPACE_ENDS = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"
#: Markers of counter-evidence and limitations.
LIMITATIONS = ("counter", "contradict", "however", "limitation", "caveat", "exception", "反証", "矛盾", "一方で", "しかし", "限界", "制約", "例外", "注意")
#: Characters that grounding ignores beside white space.
IGNORED = "、，。．「」『』\"'“”‘’()（）"
#: Full-width forms and their ASCII characters.
WIDE, NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
#: Generic terms, the most specific first.
GENERIC = ("コストパフォーマンス", "コスパ", "安心", "便利", "効率", "時短", "手軽", "楽をしたい", "楽したい", "お得", "承認欲求", "自己実現", "自己肯定感", "自分らしさ", "帰属意識", "満足感")
ECHO, ECHO_CHARS = 0.5, 4


def split_passages(docs: DataFrame, limit: int = CHUNK) -> DataFrame:
    """(doc_id, pos, passage): texts (doc_id, text) cut at two line feeds in a row, trimmed of all white space, longer pieces
    cut hard at ``limit``; no blank ones. A line that holds blanks is no cut."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n"))
    pieces = docs.select("doc_id", F.posexplode(F.split(text, "\n\n")).alias("block", "piece")).withColumn("piece", F.regexp_replace("piece", SPACE_ENDS, "")).filter("piece <> ''")
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("piece"), F.lit(1)), F.lit(limit))
    cut = pieces.select("doc_id", "block", "piece", F.posexplode(starts).alias("part", "at")).select("doc_id", "block", "part", F.substring("piece", F.col("at"), F.lit(limit)).alias("passage"))
    return cut.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("block", "part")) - 1).alias("pos"), "passage")


def drop_noise(passages: DataFrame) -> DataFrame:
    """Passages with a letter or a number."""
    return passages.filter(F.col("passage").rlike(r"[\p{L}\p{N}]"))


def dedupe_passages(passages: DataFrame, *by: str) -> DataFrame:
    """The first of each passage in (doc_id, pos) order, in all rows or in each group ``by``, by lower-cased text with single
    blanks. Hashes are shuffled, and repeats are reduced before the shuffle, so a passage that very many documents share is no
    hot group."""
    key = F.sha2(F.trim(F.regexp_replace(F.lower("passage"), r"\s+", " ")).cast("binary"), 256)
    first = passages.select("doc_id", "pos", *by, key.alias("key")).groupBy(*by, "key").agg(F.min(F.struct("doc_id", "pos")).alias("first")).select("first.*")
    return passages.join(first, ["doc_id", "pos"], "left_semi")


def flag_limitations(passages: DataFrame) -> DataFrame:
    """Passages with is_limitation: a marker of counter-evidence or a limitation occurs."""
    return passages.withColumn("is_limitation", F.lower("passage").rlike("|".join(LIMITATIONS)))


def _packed(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The packs of passages (doc_id, pos, n) that come in order; only the open pack outlives a batch."""
    names = ("doc_id", "pack", "first_pos", "last_pos", "chars")
    doc = pack = first = last = chars = None
    schema = None
    for batch in batches:
        schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("pack", pa.int32()), ("first_pos", pa.int32()), ("last_pos", pa.int32()), ("chars", pa.int64())])
        done = []
        for d, pos, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "pos", "n"))):
            if d == doc and chars + SEPARATOR + n <= limit:
                last, chars = pos, chars + SEPARATOR + n
                continue
            if doc is not None:
                done.append((doc, pack, first, last, chars))
            pack = pack + 1 if d == doc else 0
            doc, first, last, chars = d, pos, pos, n
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], schema=schema)
    if doc is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (doc, pack, first, last, chars)))], schema=schema)


def pack_passages(passages: DataFrame, limit: int = CHUNK) -> DataFrame:
    """(doc_id, pack, first_pos, last_pos, chars): adjacent passages (doc_id, pos, passage) of a document joined while they fit
    ``limit`` code points, separators counted; a longer passage is a pack of its own. Rows without an id take no part.

    One pass over lengths that Spark has sorted, so work is linear and a task holds one batch, however long a document is.
    """
    lengths = passages.filter("doc_id is not null").select("doc_id", F.col("pos").cast("int").alias("pos"), F.coalesce(F.char_length("passage"), F.lit(0)).cast("long").alias("n"))
    schema = T.StructType([T.StructField("doc_id", lengths.schema["doc_id"].dataType), T.StructField("pack", T.IntegerType()), T.StructField("first_pos", T.IntegerType()), T.StructField("last_pos", T.IntegerType()), T.StructField("chars", T.LongType())])
    return lengths.repartition("doc_id").sortWithinPartitions("doc_id", "pos").mapInArrow(partial(_packed, limit=int(limit)), schema)


def budget_passages(passages: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Which passages (project, ord, chars, protected) fit a budget of code points: protected ones first, then in order,
    skipping what is too large for what is left.

    What is left only shrinks, so of the passages of one length the earliest are taken: no more than budget / length of
    each can be. That bounds the list that a project's fold goes over, whatever the project's size. Passages of no code points fit
    always and stay outside the fold.
    """
    empty = passages.filter("chars = 0").select("project", F.col("ord").cast("long").alias("ord"))
    own = passages.withColumn("r", F.row_number().over(Window.partitionBy("project", "protected", "chars").orderBy("ord"))).filter((F.col("r") * F.col("chars") <= budget) & (F.col("chars") > 0))
    lists = own.groupBy("project").agg(F.array_sort(F.collect_list(F.struct((~F.col("protected")).alias("later"), "ord", "chars"))).alias("all"))
    fold = f"""aggregate(all, named_struct('left', cast({int(budget)} as bigint), 'kept', cast(array() as array<bigint>)), (s, p) ->
      if(p.chars <= s.left, named_struct('left', s.left - p.chars, 'kept', concat(s.kept, array(cast(p.ord as bigint)))), s), s -> s.kept)"""
    return lists.select("project", F.explode(F.expr(fold)).alias("ord")).unionByName(empty)


def _packs(clean: DataFrame, limit: int) -> DataFrame:
    """The packs of passages (project, doc_id, pos, passage): project, doc_id, pack, chars, protected."""
    sized = pack_passages(clean, limit)
    marked = flag_limitations(clean).filter("is_limitation").select("doc_id", "pos")
    named = clean.select("doc_id", "project").distinct()
    # Packs of a document do not overlap, so a marked passage has the last pack that starts at or before it.
    starts = sized.select("doc_id", F.col("first_pos").alias("pos"), F.col("pack").alias("start")).unionByName(marked.withColumn("start", F.lit(None).cast("int")))
    own = F.last("start", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos", F.col("start").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    protected = starts.withColumn("pack", own).filter("start is null").select("doc_id", "pack", F.lit(True).alias("protected")).distinct()
    return sized.join(protected, ["doc_id", "pack"], "left").join(named, "doc_id").select("project", "doc_id", "pack", "chars", F.coalesce("protected", F.lit(False)).alias("protected"))


def context_stats(docs: DataFrame, budget: int = BUDGET, limit: int = CHUNK) -> DataFrame:
    """What the context of each project of ``docs`` (project, doc_id, text) loses: documents, characters and estimated tokens
    before, of whole documents, and after, and the passages dropped as noise, duplicate and context_limit.

    Passages without a letter or number go, then repeats in the project; neighbours that are left are packed up to ``limit``
    and take part in the ``budget``, those with a limitation first, else in the order of documents. Documents without a passage
    count before. Null texts are empty, a NULL project is one of its own, ids are unique.
    """
    name = F.coalesce("project", F.lit("")).alias("name")
    known = docs.select(F.struct(F.col("project").isNull().alias("none"), name).alias("project"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    before = known.groupBy("project").agg(F.count("*").alias("before_documents"), F.sum(F.char_length("text")).alias("before_chars"))
    # Texts are split once; what comes after reads each step's rows, and the passages only as far as they stay.
    cut = written(split_passages(known, limit).join(known.select("doc_id", "project"), "doc_id"), "context-passages")
    heard = drop_noise(cut)
    clean = written(dedupe_passages(heard, "project"), "context-clean")
    packs = written(placed(_packs(clean, limit), ["project"], [F.col("doc_id")], ["pack"], "ord"), "context-packs")
    kept = budget_passages(packs, budget).join(packs.withColumn("ord", F.col("ord").cast("long")), ["project", "ord"])
    after = kept.groupBy("project").agg(F.count_distinct("doc_id").alias("after_documents"), F.sum("chars").alias("after_chars"), F.count("*").alias("kept"))
    count = lambda rows, name: rows.groupBy("project").agg(F.count("*").alias(name))
    rows = before.join(after, "project", "left")
    for table, column in ((cut, "cut"), (heard, "heard"), (clean, "clean"), (packs, "packs")):
        rows = rows.join(count(table, column), "project", "left")
    rows = rows.na.fill(0)
    token = lambda c: F.floor((F.col(c) + 1) / 2)
    return rows.select(
        F.when(~F.col("project.none"), F.col("project.name")).alias("project"),
        "before_documents",
        "before_chars",
        "after_documents",
        "after_chars",
        token("before_chars").alias("before_tokens"),
        token("after_chars").alias("after_tokens"),
        (F.col("cut") - F.col("heard")).alias("noise"),
        (F.col("heard") - F.col("clean")).alias("duplicate"),
        (F.col("packs") - F.col("kept")).alias("context_limit"),
    )


def folded(char: Column) -> Column:
    """A text without white space and ignored characters, full-width folded, lower-cased character by character: full case
    mapping would make two characters of İ and look at what follows Σ."""
    wide = {w: n for w, n in zip(WIDE + "İΣ", NARROW + "iσ") if w not in IGNORED}
    return F.lower(F.translate(char, "".join(wide) + IGNORED + " \t\n\x0b\f\r", "".join(wide.values())))


def ground_quotes(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Quotes (quote_id, doc_id, quote) located in their documents (doc_id, text): start_offset, end_offset, exact.

    An exact place comes first, else a place in the folded text with its original offsets; others are left out. A document
    meets all its quotes at once and is folded once; characters are counted only for the quotes found in the folded text.
    """
    asked = quotes.filter(F.coalesce(F.char_length("quote"), F.lit(0)) > 0).groupBy("doc_id").agg(F.collect_list(F.struct("quote_id", "quote")).alias("asked"))
    rows = docs.select("doc_id", "text").join(asked, "doc_id").withColumn("fold", folded(F.col("text"))).select("doc_id", "text", "fold", F.explode("asked").alias("q"))
    rows = rows.select("doc_id", "text", "fold", "q.quote_id", "q.quote", F.instr("text", F.col("q.quote")).alias("at"), folded(F.col("q.quote")).alias("needle"))
    rows = rows.withColumn("near", F.when((F.col("at") == 0) & (F.col("needle") != ""), F.instr("fold", F.col("needle"))).otherwise(0)).filter("at > 0 or near > 0")
    exact = F.when(F.col("at") > 0, F.struct((F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.char_length("quote")).alias("end")))
    # Places of the characters that folding keeps, whatever it makes of them.
    kept = F.when(F.col("at") == 0, F.filter(F.transform(F.split("text", ""), lambda c, i: F.when((F.instr(F.lit(IGNORED), c) == 0) & ~c.rlike(r"\s"), i)), lambda i: i.isNotNull()))
    place = lambda k: F.element_at("kept", k.cast("int"))
    rows = rows.select("quote_id", "doc_id", "near", F.char_length("needle").alias("size"), exact.alias("exact"), kept.alias("kept"))
    found = F.coalesce("exact", F.struct(place(F.col("near")).alias("start"), (place(F.col("near") + F.col("size") - 1) + 1).alias("end")))
    return rows.select("quote_id", "doc_id", found["start"].alias("start_offset"), found["end"].alias("end_offset"), F.col("exact").isNotNull().alias("exact"))


def grounding_rate(quotes: DataFrame, grounded: DataFrame) -> DataFrame:
    """One row: candidates, grounded, unsupported_rate."""
    n = quotes.agg(F.count("*").alias("candidates")).join(grounded.agg(F.count("*").alias("grounded")))
    return n.select("candidates", "grounded", F.round(F.try_divide(F.col("candidates") - F.col("grounded"), F.col("candidates")), 9).alias("unsupported_rate"))


def need_echo(pairs: DataFrame) -> DataFrame:
    """Pairs (id, stated, latent) with echo: one folded text holds the other, or their character pairs' Jaccard index is 0.5
    or more; texts under four characters never echo."""
    rows = pairs.select("id", folded(F.col("stated")).alias("a"), folded(F.col("latent")).alias("b"))
    # Pairs that start at even places and at odd ones; an exact search for them costs no function a character.
    every = lambda c: F.regexp_extract_all(c, F.lit("(?s)(..)"), F.lit(1))
    grams = lambda c: F.array_distinct(F.concat(every(c), every(F.substring(c, 2, 2**31 - 1))))
    enough = (F.char_length("a") >= ECHO_CHARS) & (F.char_length("b") >= ECHO_CHARS)
    inside = F.contains("a", F.col("b")) | F.contains("b", F.col("a"))
    rows = rows.select("id", F.when(~enough, False).when(inside, True).alias("known"), "a", "b")
    open_ = lambda c: F.when(F.col("known").isNull(), grams(F.col(c)))
    rows = rows.select("id", "known", open_("a").alias("ga"), open_("b").alias("gb"))
    rows = rows.select("id", "known", "ga", "gb", F.size(F.array_intersect("ga", "gb")).alias("both"))
    jaccard = F.try_divide("both", F.size("ga") + F.size("gb") - F.col("both"))
    return rows.select("id", F.coalesce("known", jaccard >= ECHO).alias("echo"))


def generic_terms(texts: DataFrame, terms: tuple[str, ...] = GENERIC) -> DataFrame:
    """(id, term): the first of ``terms`` inside each text (id, text), NULL if there is none; both are ``folded``, so spaced and
    full-width forms are found."""
    own = texts.select("id", folded(F.col("text")).alias("fold"))
    return own.select("id", F.coalesce(*[F.when(F.contains("fold", folded(F.lit(t))), t) for t in terms]).alias("term"))


def quality_flags(findings: DataFrame, deviations: DataFrame, needs_profile: str) -> DataFrame:
    """Findings (id, profile, stated, echo, term, expectation, surprising, competing) with ordered flags; ``deviations``: ids of
    findings that cite a deviation pattern.

    Echo and generic terms judge needs, so they are flags only of the profile ``needs_profile`` and beside a stated need.
    """
    rows = findings.join(deviations.select("id", F.lit(True).alias("deviates")).distinct(), "id", "left")
    blank = lambda c: F.coalesce(F.regexp_replace(c, SPACE_ENDS, ""), F.lit("")) == ""
    needs = F.coalesce(F.col("profile") == needs_profile, F.lit(False)) & ~blank("stated")
    flags = F.concat_ws(",", F.when(needs & F.col("echo"), "STATED_NEED_ECHO"), F.when(needs & F.col("term").isNotNull(), "GENERIC_TERM"), F.when(F.col("deviates").isNull(), "NO_DEVIATION_PATTERN"), F.when(blank("expectation") | blank("surprising"), "INCOMPLETE_EXPECTATION"), F.when(F.col("competing") < 3, "FEW_COMPETING"))
    return rows.select("id", flags.alias("flags"))


def evidence_rows(cited: DataFrame, observations: DataFrame) -> DataFrame:
    """Distinct existing observations of each finding's list (finding_id, observation_ids) in order, with their rank and
    relevance max(0.5, 1 - 0.05 * rank)."""
    rows = cited.select("finding_id", F.posexplode("observation_ids").alias("pos", "observation_id")).groupBy("finding_id", "observation_id").agg(F.min("pos").alias("pos"))
    rows = rows.join(observations.select("observation_id", "doc_id"), "observation_id").withColumn("rank", F.row_number().over(Window.partitionBy("finding_id").orderBy("pos")) - 1)
    return rows.select("finding_id", "observation_id", "doc_id", "rank", F.round(F.greatest(F.lit(0.5), 1 - 0.05 * F.col("rank")), 2).alias("relevance"))


def evidence_confidence(evidence: DataFrame, total_documents: DataFrame, pattern_documents: DataFrame) -> DataFrame:
    """Per finding of evidence (finding_id, doc_id, source, type, relevance, project): a confidence from 0 to 1.

    0.35 * mean relevance + 0.25 * share of the project's documents + 0.2 * sources / 5 of support + 0.2 * documents of
    the finding's pattern / 5, less a tenth for each of up to three counters. ``total_documents``: project, n;
    ``pattern_documents``: finding_id, doc_id, the documents that show the pattern, repeats counted once; none is 0.
    """
    support = F.col("type") == "support"
    rows = evidence.groupBy("project", "finding_id").agg(
        F.avg(F.when(support, F.col("relevance"))).alias("mean"), F.count_distinct(F.when(support, F.col("doc_id"))).alias("docs"), F.count_distinct(F.when(support, F.col("source"))).alias("sources"), F.count_if(support).alias("supports"), F.count_if(F.col("type") == "counter").alias("counters")
    )
    shown = pattern_documents.groupBy("finding_id").agg(F.count_distinct("doc_id").alias("shown"))
    rows = rows.join(total_documents, "project").join(shown, "finding_id", "left")
    score = 0.35 * F.coalesce("mean", F.lit(0.0)) + 0.25 * F.least(F.lit(1.0), F.coalesce(F.try_divide("docs", "n"), F.lit(0.0))) + 0.2 * F.least(F.lit(1.0), F.col("sources") / 5) + 0.2 * F.least(F.lit(1.0), F.coalesce("shown", F.lit(0)) / 5)
    value = F.when(F.col("supports") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score * (1 - 0.1 * F.least(F.col("counters"), F.lit(3)))))).otherwise(0.0)
    return rows.select("finding_id", "supports", "counters", F.round(value, 6).alias("confidence"))


def validation_status(scored: DataFrame) -> DataFrame:
    """(finding_id, status) from supports and counters."""
    s, c = F.col("supports"), F.col("counters")
    return scored.select("finding_id", F.when(s == 0, "INSUFFICIENT_EVIDENCE").when(c >= s, "CONTRADICTED").when(c > 0, "PARTIALLY_SUPPORTED").otherwise("PLAUSIBLE").alias("status"))


def filter_pattern_refs(patterns: DataFrame, observations: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Patterns (id, deviation_type, observation_ids) with existing observations only, in order; patterns left without any
    go, and an unknown deviation type becomes other."""
    refs = patterns.select("id", "deviation_type", F.posexplode("observation_ids").alias("pos", "observation_id")).join(observations.select("observation_id").distinct(), "observation_id", "left_semi")
    kept = refs.groupBy("id", "deviation_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "observation_id"))), lambda x: x["observation_id"].cast("string")), ",").alias("observations"))
    return kept.select("id", F.when(F.col("deviation_type").isNull() | F.col("deviation_type").isin(*kinds), F.col("deviation_type")).otherwise("other").alias("deviation_type"), "observations")


def expand_alternatives(findings: DataFrame) -> DataFrame:
    """One row for each primary (id, title, competing ARRAY) and each competing explanation: set_id, pos, role, title, size."""
    size = F.size(F.coalesce("competing", F.array().cast("array<string>"))) + 1
    primary = findings.select(F.col("id").alias("set_id"), F.lit(0).alias("pos"), F.lit("PRIMARY").alias("role"), "title", size.alias("set_size"))
    others = findings.select(F.col("id").alias("set_id"), size.alias("set_size"), F.posexplode("competing").alias("pos", "title")).select("set_id", (F.col("pos") + 1).alias("pos"), F.lit("COMPETING").alias("role"), "title", "set_size")
    return primary.unionByName(others)


def apply_duplicate_groups(items: DataFrame, groups: DataFrame) -> DataFrame:
    """Items (idx) without those of each group (group_id, idx) but its lowest; overlapping groups are not merged."""
    low = groups.groupBy("group_id").agg(F.min("idx").alias("low"))
    dropped = groups.join(low, "group_id").filter("idx <> low").select("idx").distinct()
    return items.join(dropped, "idx", "left_anti")


def run_metrics(findings: DataFrame) -> DataFrame:
    """Rates per run of findings (run, supports, counters, searched, traced, flags): evidence coverage, searches for counter-evidence,
    mean evidence, traced, flagged, and flag_counts, how many findings have each flag of the comma-separated ``flags``, as
    CODE=n in order of the codes. A search counts whether it found counters or not; a NULL is none."""
    n = F.count("*")
    rate = lambda c: F.round(F.try_divide(F.count_if(c), n), 6)
    rates = findings.groupBy("run").agg(n.alias("findings"), rate(F.col("supports") > 0).alias("evidence_coverage"), rate(F.col("searched")).alias("counter_coverage"), F.round(F.avg(F.col("supports") + F.col("counters")), 6).alias("mean_evidence"), rate(F.col("traced")).alias("traced_rate"), rate(F.col("flags") != "").alias("flagged_rate"))
    codes = findings.select("run", F.explode(F.array_distinct(F.split("flags", ","))).alias("code")).filter("code <> ''").groupBy("run", "code").count()
    counts = codes.groupBy("run").agg(F.array_join(F.array_sort(F.collect_list(F.concat("code", F.lit("="), F.col("count").cast("string")))), ",").alias("flag_counts"))
    r = counts.select(F.col("run").alias("r"), "flag_counts")
    return rates.join(r, F.col("run").eqNullSafe(F.col("r")), "left").drop("r").withColumn("flag_counts", F.coalesce("flag_counts", F.lit("")))


def control_candidates(variables: DataFrame) -> DataFrame:
    """Variables (finding_id, name, role, status) that are supported confounders."""
    return variables.filter((F.col("role") == "CONFOUNDER") & (F.col("status") == "SUPPORTED")).select("finding_id", "name")
