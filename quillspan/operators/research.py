"""Gaps, hypotheses, claims and scenarios over many runs and iterations at once.

Tables are keyed by ``run`` and ``seq``, an iteration's number in its run. Nothing is resolved or supported without evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.places import placed
from quillspan.functions.shared import written
from quillspan.functions.values import need_key

#: Words of a need that name its category; the first category that has one counts.
CATEGORIES = (
    ("COMPARISON", ("comparison", "control group", "control region", "対照")),
    ("PRE_PERIOD", ("pre-period", "pre policy", "before treatment", "baseline trend", "導入前")),
    ("TIMING", ("timing", "implementation date", "policy date", "時期", "タイミング")),
    ("CONFOUNDER", ("confound", "population", "economic condition", "交絡", "人口", "景気")),
    ("MEASUREMENT", ("measurement", "definition", "registration", "schema change", "測定", "定義", "登記")),
    ("SOURCE_QUALITY", ("source quality", "missing source", "provenance", "出典", "品質")),
    ("EXTERNAL_CONTEXT", ("external context", "macro", "national trend", "外部", "全国")),
)
#: Dimensions, period and source of the data that a category's gap asks for.
REQUIREMENTS = (
    ("COMPARISON", "group,time", "matched analysis period", "comparison dataset"),
    ("PRE_PERIOD", "unit,time", "pre-exposure period", "historical records"),
    ("TIMING", "event,date", "", "documented event chronology"),
    ("CONFOUNDER", "candidate confounder,unit,time", "analysis period", "official or audited statistics"),
    ("MEASUREMENT", "measure,definition,version", "", "measurement documentation"),
    ("EXTERNAL_CONTEXT", "context,time", "analysis period", "external contextual data"),
    ("SOURCE_QUALITY", "source,version,provenance", "", "source documentation"),
    ("OTHER", "", "", "unspecified"),
)
DEPENDENT = ("COMPARISON", "PRE_PERIOD", "CONFOUNDER", "EXTERNAL_CONTEXT")
PREREQUISITE = ("MEASUREMENT", "SOURCE_QUALITY")
#: Tasks that the gaps of one list are dealt to, tasks that build lists, most tasks of long lists, characters of a long list.
SALTS, TASKS, CELLS, WIDE = 8, 48, 4_096, 1 << 14
#: Order of validation states, weakest first.
RANKS = {"CONTRADICTED": -1, "UNTESTED": 0, "INSUFFICIENT_EVIDENCE": 1, "PLAUSIBLE": 2, "PARTIALLY_SUPPORTED": 3, "SUPPORTED": 4}
#: Wording that claims a cause, or everything.
CAUSAL = r"(?i)\b(caus(e|ed|es|ing)|because( of)?|due to|led to|leads? to|lead to|result(ed|s)? in|drives?|drove|driven by|effect of|impact of|attributable to)\b|が原因|のせいで|によって|により|をもたらし|を引き起こ|効果があった|押し上げ"
UNIVERSAL = r"(?i)\b(all|always|never|every|everyone|everybody|no one|nobody|universally|in every case)\b|すべて|全て|必ず|常に|誰もが|一切|例外なく"


#: Origins of expectations, by whether the data could have been seen; two older names; those that need a source.
BEFORE = ("PRIOR", "LITERATURE", "DOMAIN_KNOWLEDGE", "DERIVED_FROM_PRIOR_RUN")
AFTER = ("MODEL_PROPOSED_POST_HOC", "HUMAN_POST_HOC", "MODEL_PROPOSED")
UNTIMED = ("OTHER", "UNKNOWN", "SOURCE_BACKED")
SOURCED = ("LITERATURE", "DOMAIN_KNOWLEDGE")
#: Authors of expectations, kinds of assumptions and relations, directions, origins of scenario sets.
AUTHORS = ("HUMAN", "MODEL", "IMPORTED")
ASSUMPTIONS = ("OBSERVED_BASELINE", "EXOGENOUS_ASSUMPTION", "MODEL_ASSUMPTION", "HUMAN_ASSUMPTION", "POLICY_ASSUMPTION")
RELATIONS = ("MUTUALLY_EXCLUSIVE", "OVERLAPPING", "NESTED", "CONFLICTING")
DIRECTIONS = ("", "INCREASE", "DECREASE", "NO_CHANGE", "RANGE")


def category(need: Column) -> Column:
    low = F.lower(F.coalesce(need, F.lit("")))
    return F.coalesce(*[F.when(F.greatest(*[F.contains(low, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(low, F.lit(words[0])), name) for name, words in CATEGORIES], F.lit("OTHER"))


def classify_gaps(gaps: DataFrame) -> DataFrame:
    """Gaps (…, need) with their category."""
    return gaps.withColumn("category", category(F.col("need")))


def joined_set(c: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), ",")


def collect_gaps(gaps: DataFrame) -> DataFrame:
    """Gaps (run, seq, need, hypothesis) merged by need: run, seq, need_key, hypotheses, n_hypotheses."""
    return gaps.groupBy("run", "seq", need_key(F.col("need")).alias("need_key")).agg(joined_set(F.col("hypothesis").cast("string")).alias("hypotheses"), F.count_distinct("hypothesis").alias("n_hypotheses"))


def plan_requirements(gaps: DataFrame) -> DataFrame:
    """What to collect for each gap (gap_id, need): dimensions, period, source category."""
    lookup = gaps.sparkSession.createDataFrame(REQUIREMENTS, "category string, dimensions string, period string, source_category string")
    return classify_gaps(gaps.select("gap_id", "need")).join(F.broadcast(lookup), "category").select("gap_id", "need", "category", "dimensions", "period", "source_category")


def gap_dependencies(gaps: DataFrame, wide: int = WIDE) -> DataFrame:
    """(run, gap_id, depends_on): gaps that compare or adjust depend on open measurement and source gaps that share a
    hypothesis; from (run, gap_id, category, resolved, hypothesis), one row a hypothesis.

    A list is built once for the gaps that ask for the same hypotheses, as text, and joined last, so no shuffle holds a list a
    gap; a gap that is among its own prerequisites is cut out of the text. Gaps of a list of over ``wide`` characters come in
    tasks of their own, ``SALTS`` a list, so a writer of the rows meets one long text only. The result itself grows with the
    square of a hypothesis' gaps.
    """
    asking, open_ones, met = _prerequisites(gaps, written)
    shown = lambda i: F.lpad(i.cast("string"), 8, "0")
    members = open_ones.groupBy("run", "held").agg(F.collect_list(shown(F.col("gap_id"))).alias("ids"))
    sizes = met.join(open_ones.groupBy("run", "held").agg(F.count("*").alias("n")), ["run", "held"]).groupBy("run", "asks").agg(F.sum("n").alias("n"))
    lists = met.join(members, ["run", "held"]).repartition(TASKS, "run", "asks").groupBy("run", "asks").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    twice = F.array_distinct(F.filter("ids", lambda x, i: F.coalesce(F.get("ids", i + 1) == x, F.lit(False))))  # texts of several gaps
    lists = lists.select("run", "asks", F.array_join(F.array_distinct("ids"), ",").alias("whole"), twice.alias("twice"))
    lists = lists.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asking = asking.withColumn("salt", F.pmod(F.xxhash64("gap_id"), F.lit(SALTS)).cast("int"))
    long = written(sizes.filter(F.col("n") * 9 > wide).select("run", "asks", (F.row_number().over(Window.orderBy("run", "asks")) - 1).alias("place")), "long-lists")
    n = long.count()
    if n:
        cells = lambda rows, *names: rows.join(long, ["run", "asks"]).select(*names, (F.col("place") * SALTS + F.col("salt")).alias("cell")).repartitionById(min(n * SALTS, CELLS), F.col("cell"))
        apart = cells(asking, "run", "gap_id", "own").join(cells(lists, "whole", "twice").hint("merge"), "cell")
        asking, lists = (rows.join(long, ["run", "asks"], "left_anti") for rows in (asking, lists))
    columns = ("run", "gap_id", "own", "whole", "twice")
    rows = asking.join(lists, ["run", "asks", "salt"]).select(*columns)
    rows = rows.unionByName(apart.select(*columns)) if n else rows
    text = shown(F.col("gap_id"))
    rest = F.array_join(F.filter(F.split("whole", ","), lambda x: x != text), ",")
    depends_on = F.when(F.col("own") & ~F.array_contains("twice", text), rest).otherwise(F.col("whole"))
    return rows.select("run", "gap_id", depends_on.alias("depends_on")).filter("depends_on <> ''")


def _prerequisites(gaps: DataFrame, kept=lambda rows, name: rows) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Who waits for whom, by sets of hypotheses and not by pairs of gaps: dependent gaps (run, gap_id, asks, own), the sorted
    hypotheses that they ask for and whether they are among their own prerequisites; open prerequisites (run, gap_id, held) with
    the hypotheses that they are open for; and the sets that share one (run, asks, held). ``kept`` may write the first two."""
    of = lambda rows, name: rows.filter("gap_id is not null").groupBy("run", "gap_id").agg(F.array_sort(F.collect_set("hypothesis")).alias(name)).filter(F.size(name) > 0)
    open_ones = kept(of(gaps.filter(F.col("category").isin(*PREREQUISITE) & ~F.col("resolved")), "held"), "open-gaps")
    asking = of(gaps.filter(F.col("category").isin(*DEPENDENT)), "asks").join(open_ones, ["run", "gap_id"], "left")
    asking = kept(asking.select("run", "gap_id", "asks", F.coalesce(F.arrays_overlap("asks", "held"), F.lit(False)).alias("own")), "asking-gaps")
    each = lambda rows, name: rows.select("run", name).distinct().select("run", name, F.explode(name).alias("hypothesis"))
    met = each(asking, "asks").join(each(open_ones, "held"), ["run", "hypothesis"]).select("run", "asks", "held").distinct()
    return asking, open_ones, met


def _waits(gaps: DataFrame) -> DataFrame:
    """(run, gap_id, waits): how many gaps each dependent gap waits for, from the sizes of the sets; those without have no row."""
    asking, open_ones, met = _prerequisites(gaps)
    sizes = met.join(open_ones.groupBy("run", "held").agg(F.count("*").alias("n")), ["run", "held"]).groupBy("run", "asks").agg(F.sum("n").alias("n"))
    return asking.join(sizes, ["run", "asks"]).select("run", "gap_id", (F.col("n") - F.col("own").cast("int")).alias("waits"))


def rank_requirements(gaps: DataFrame, states: DataFrame) -> DataFrame:
    """Gaps (run, gap_id, need, category, resolvable, resolved, hypothesis) as ranked requirements; ``states``: run, hypothesis,
    identified, validation. Ordered by power, urgency, the number of gaps that it depends on, difficulty, need."""
    power = F.when(F.col("hypotheses") == 0, 0).when(F.col("category").isin("COMPARISON", "PRE_PERIOD", "CONFOUNDER"), 3).when(F.col("category").isin("TIMING", "MEASUREMENT"), 2).otherwise(1)
    known = gaps.join(states, ["run", "hypothesis"], "left")
    facts = known.groupBy("run", "gap_id", "need", "category", "resolvable").agg(F.count_distinct("hypothesis").alias("hypotheses"), F.coalesce(F.max(~F.col("identified")), F.lit(False)).alias("unidentified"), F.coalesce(F.max(F.col("validation").isin("UNTESTED", "INSUFFICIENT_EVIDENCE")), F.lit(False)).alias("untested"), F.count("identified").alias("known"))
    rows = facts.withColumn("power", power)
    urgency = F.when((F.col("power") == 3) & F.col("unidentified"), 3).when(((F.col("power") == 2) & (F.col("known") > 0)) | F.col("untested"), 2).otherwise(1)
    source = F.col("category")
    difficulty = F.when(~F.col("resolvable"), 4).when(source.isin("TIMING", "MEASUREMENT", "SOURCE_QUALITY"), 0).when(source.isin("PRE_PERIOD", "CONFOUNDER", "EXTERNAL_CONTEXT"), 1).when(source == "COMPARISON", 2).otherwise(3)
    rows = rows.withColumn("urgency", urgency).withColumn("difficulty", difficulty)
    rows = rows.join(_waits(gaps), ["run", "gap_id"], "left").withColumn("waits", F.coalesce("waits", F.lit(0)))
    rows = placed(rows, ["run"], [-F.col("power"), -F.col("urgency"), F.col("waits"), F.col("difficulty"), F.col("need")], ["gap_id"], "rank")
    return rows.select("run", "gap_id", "power", "urgency", "difficulty", (F.col("hypotheses") >= 2).alias("can_distinguish"), ((F.col("hypotheses") >= 1) & (F.col("category") != "OTHER")).alias("can_falsify"), "rank")


def carry_forward_gaps(seen: DataFrame, iterations: DataFrame, evidence: DataFrame) -> DataFrame:
    """State of each gap at each iteration from its first on: run, need_key, seq, state (OPEN, CARRIED, RESOLVED).

    ``seen``: run, seq, need_key; ``iterations``: run, seq; ``evidence``: run, seq, need_key (NULL: linked to no gap). A gap
    that vanishes is resolved only where evidence targets it, or where an iteration's evidence is linked to no gap at all.
    """
    first = seen.groupBy("run", "need_key").agg(F.min("seq").alias("first"))
    every = first.join(iterations.select("run", "seq").distinct(), "run").filter("seq >= first").select("run", "need_key", "seq")
    here = seen.select("run", "need_key", "seq", F.lit(True).alias("here")).distinct()
    aimed = evidence.filter("need_key is not null").select("run", "need_key", "seq", F.lit(True).alias("aimed")).distinct()
    loose = evidence.groupBy("run", "seq").agg((F.count("need_key") == 0).alias("loose"))
    rows = every.join(here, ["run", "need_key", "seq"], "left").join(aimed, ["run", "need_key", "seq"], "left").join(loose, ["run", "seq"], "left")
    event = F.when(F.col("here"), "OPEN").when(F.coalesce("aimed", "loose", F.lit(False)), "RESOLVED")
    state = F.last(event, ignorenulls=True).over(Window.partitionBy("run", "need_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("state", state).select("run", "need_key", "seq", F.when((F.col("state") == "OPEN") & F.col("here").isNull(), "CARRIED").otherwise(F.col("state")).alias("state"))


def rank_of(status: Column) -> Column:
    return F.coalesce(*[F.when(status == k, v) for k, v in RANKS.items()])


def hypothesis_evolution(states: DataFrame) -> DataFrame:
    """Change of each hypothesis (run, seq, title, status) from the iteration before, matched on its normalised title."""
    rows = states.groupBy("run", "seq", need_key(F.col("title")).alias("key")).agg(F.max_by("status", rank_of(F.col("status"))).alias("status"))
    prev = rows.select("run", "key", (F.col("seq") + 1).alias("seq"), F.col("status").alias("before"))
    rows = rows.join(prev, ["run", "key", "seq"], "left")
    now, then = rank_of(F.col("status")), F.greatest(rank_of(F.col("before")), F.lit(0))
    change = F.when(F.col("before").isNull(), "CREATED").when(F.col("status") == F.col("before"), "UNCHANGED").when(F.col("status") == "CONTRADICTED", "CONTRADICTED").when(now > then, "STRENGTHENED").otherwise("WEAKENED")
    return rows.select("run", "key", "seq", "status", change.alias("change"))


def iteration_delta(lists: DataFrame) -> DataFrame:
    """Added and removed members of each iteration's list (run, seq, kind, member) against the iteration before."""
    rows = lists.groupBy("run", "seq", "kind").agg(F.collect_set("member").alias("now"))
    prev = rows.select("run", "kind", (F.col("seq") + 1).alias("seq"), F.col("now").alias("before"))
    both = rows.join(prev, ["run", "kind", "seq"])
    text = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return both.select("run", "kind", "seq", text("now", "before").alias("added"), text("before", "now").alias("removed"))


def hypothesis_summary(states: DataFrame) -> DataFrame:
    """Counts of surviving, supported (in part too), strong and contradicted hypotheses per iteration, and the title of the
    strongest surviving one, NULL where none survives."""
    s = F.col("status")
    best = F.min(F.when(s != "CONTRADICTED", F.struct((-rank_of(s)).alias("r"), "title")))
    return states.groupBy("run", "seq").agg(F.count_if(s != "CONTRADICTED").alias("surviving"), F.count_if(s.isin("PARTIALLY_SUPPORTED", "SUPPORTED")).alias("supported"), F.count_if(s == "SUPPORTED").alias("strong"), F.count_if(s == "CONTRADICTED").alias("contradicted"), best["title"].alias("strongest"))


def decision_readiness(runs: DataFrame) -> DataFrame:
    """The readiness of each run from its facts (run, iterations, hypotheses, open_gaps, resolvable_gaps, supported, strong,
    evidence, high_open, moved); see ``hypothesis_summary``. A single pass is never decision-ready."""
    one = (F.col("supported") == 1) & (F.col("strong") == 1)
    state = (
        F.when((F.col("iterations") == 0) | (F.col("hypotheses") == 0), "EVIDENCE_INSUFFICIENT")
        .when((F.col("open_gaps") > 0) & (F.col("resolvable_gaps") == 0), "BLOCKED")
        .when(F.col("supported") == 0, "EVIDENCE_INSUFFICIENT")
        .when((F.col("iterations") == 1) | (F.col("evidence") == 0), "EXPLORATORY_ONLY")
        .when(F.col("high_open") > 0, F.when(one, "EVIDENCE_CONVERGING").otherwise("VALIDATION_REQUIRED"))
        .when(one, "DECISION_READY_WITH_LIMITATIONS")
        .when(F.col("supported") == 1, "EVIDENCE_CONVERGING")
        .when(~F.col("moved"), "INCONCLUSIVE")
        .otherwise("EVIDENCE_CONVERGING")
    )
    return runs.withColumn("state", state)


def stop_reason(ready: DataFrame) -> DataFrame:
    """(run, reason) for runs with a state, open_gaps and unidentified: why the system stops, NULL where it goes on."""
    s = F.col("state")
    return ready.select("run", F.when(s == "DECISION_READY_WITH_LIMITATIONS", "HYPOTHESES_DISTINGUISHED").when(s == "BLOCKED", "NO_FEASIBLE_DATA_SOURCE").when((s == "INCONCLUSIVE") & (F.col("open_gaps") == 0) & F.col("unidentified"), "IDENTIFICATION_UNRESOLVED").when(s == "INCONCLUSIVE", "CONFLICTING_EVIDENCE_REMAINS").alias("reason"))


def open_gap_handoff(carried: DataFrame, changes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per run, at its latest iteration: open gaps, weakened or contradicted hypotheses, and evidence added in all."""
    last = Window.partitionBy("run").orderBy(F.desc("seq"))
    latest = carried.withColumn("k", F.rank().over(last)).filter("k = 1")
    gaps = latest.groupBy("run").agg(F.max("seq").alias("seq"), F.count_if(F.col("state") != "RESOLVED").alias("open_gaps"))
    weak = changes.filter(F.col("change").isin("WEAKENED", "CONTRADICTED")).groupBy("run", "seq").agg(joined_set(F.col("key")).alias("weakened"))
    added = evidence.groupBy("run").agg(F.count("*").alias("evidence_added"))
    return gaps.join(weak, ["run", "seq"], "left").join(added, "run", "left").select("run", "seq", "open_gaps", F.coalesce("weakened", F.lit("")).alias("weakened"), F.coalesce("evidence_added", F.lit(0)).alias("evidence_added"))


def claim_citations(refs: DataFrame, observations: DataFrame, documents: DataFrame) -> DataFrame:
    """References (claim_id, ref), trimmed, blank ones left out, as an observation, else a document by id or external ref, else
    NOT_FOUND: claim_id, ref, kind, doc_id, observation_id (text)."""
    refs = refs.select("claim_id", F.trim("ref").alias("ref")).filter("ref <> ''")
    obs = observations.select(F.col("id").cast("string").alias("ref"), F.lit("OBSERVATION").alias("o"))
    by_id = documents.select(F.col("id").cast("string").alias("ref"), F.col("id").alias("d"))
    by_ext = documents.filter("ext is not null").groupBy(F.col("ext").alias("ref")).agg(F.min("id").alias("e"))
    rows = refs.join(obs, "ref", "left").join(by_id, "ref", "left").join(by_ext, "ref", "left")
    kind = F.coalesce("o", F.when(F.coalesce("d", "e").isNotNull(), "DOCUMENT"), F.lit("NOT_FOUND"))
    return rows.select("claim_id", "ref", kind.alias("kind"), F.when(F.col("o").isNull(), F.coalesce("d", "e")).alias("doc_id"), F.when(F.col("o").isNotNull(), F.col("ref")).alias("observation_id"))


def claim_basis(claims: DataFrame, named: DataFrame, cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, hypothesis, role): a claim's named hypotheses, else those whose evidence it cites (BASIS), by document or by
    observation; other hypotheses that use what it cites are COMPETING. ``evidence``: hypothesis, doc_id, observation_id (text,
    may be NULL)."""
    by = lambda key: cited.filter(F.col(key).isNotNull()).select("claim_id", key).distinct().join(evidence.select("hypothesis", key).distinct(), key).select("claim_id", "hypothesis")
    by_cite = by("doc_id").unionByName(by("observation_id")).distinct()
    without = claims.select("claim_id").join(named, "claim_id", "left_anti")
    basis = named.select("claim_id", "hypothesis").distinct().unionByName(by_cite.join(without, "claim_id", "left_semi"))
    rest = by_cite.join(basis, ["claim_id", "hypothesis"], "left_anti")
    return basis.withColumn("role", F.lit("BASIS")).unionByName(rest.withColumn("role", F.lit("COMPETING")))


def claim_evidence(basis: DataFrame, cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per claim: support, counter and neutral evidence of its basis among the documents and observations that it cites.

    What a claim cites meets its evidence by document or observation and the basis last, so work grows with the citations and
    not with claims times the evidence of a hypothesis. Evidence that a claim cites by both counts once.
    """
    kinds = ("support", "counter", "neutral")
    own = evidence.groupBy("hypothesis", "doc_id", "observation_id").agg(*[F.count_if(F.col("type") == k).alias(k) for k in kinds])
    by = lambda key: cited.filter(F.col(key).isNotNull()).select("claim_id", key).distinct()
    hit = own.join(by("doc_id"), "doc_id").select("claim_id", "hypothesis", *kinds)
    rest = own.join(by("observation_id"), "observation_id").join(by("doc_id"), ["claim_id", "doc_id"], "left_anti")
    rows = hit.unionByName(rest.select("claim_id", "hypothesis", *kinds)).join(basis.filter("role = 'BASIS'"), ["claim_id", "hypothesis"])
    return rows.groupBy("claim_id").agg(*[F.sum(k).alias(k) for k in kinds])


def claim_flags(claims: DataFrame, citations: DataFrame, manifests: DataFrame, named: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Claims (claim_id, statement, identified) with ordered flags. ``manifests``: doc_id, unit, population, granularity,
    schema_version; cited documents whose known values of one of these differ are a mismatch. ``named``: claim_id, hypothesis,
    which should be among ``hypotheses`` (hypothesis)."""
    cites = citations.groupBy("claim_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "NOT_FOUND").alias("lost"))
    known = lambda c: F.when(F.trim(c) != "", F.col(c))
    fields = ("unit", "population", "granularity", "schema_version")
    used = citations.filter("doc_id is not null").select("claim_id", "doc_id").join(manifests.select("doc_id", *[known(f).alias(f) for f in fields]), "doc_id")
    mixed = used.groupBy("claim_id").agg(F.greatest(*[F.coalesce(F.min(f) != F.max(f), F.lit(False)) for f in fields]).alias("mixed"))
    unknown = named.join(hypotheses, "hypothesis", "left_anti").select("claim_id", F.lit(True).alias("unknown")).distinct()
    rows = claims.join(cites, "claim_id", "left").join(mixed, "claim_id", "left").join(unknown, "claim_id", "left")
    causal = F.coalesce(F.col("statement"), F.lit("")).rlike(CAUSAL) & ~F.coalesce("identified", F.lit(False))
    flags = F.concat_ws(
        ",",
        F.when(F.coalesce("n", F.lit(0)) == 0, "NO_SOURCE_CITATION"),
        F.when(F.col("lost") > 0, "CITATION_NOT_FOUND"),
        F.when(F.col("unknown"), "HYPOTHESIS_NOT_FOUND"),
        F.when(causal, "CAUSAL_LANGUAGE_WITHOUT_IDENTIFICATION"),
        F.when(F.coalesce("statement", F.lit("")).rlike(UNIVERSAL), "OVERGENERALIZATION_LANGUAGE"),
        F.when(F.col("mixed"), "DEFINITION_OR_POPULATION_MISMATCH"),
    )
    return rows.select("claim_id", flags.alias("flags"))


def claim_status(basis: DataFrame, states: DataFrame, flags: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, status, flag) from the states (hypothesis, status) of its basis and competitors.

    Only a claim whose whole basis is supported, at least in part, without an open competitor, causal overreach
    (``claim_flags``) or a lack of cited evidence (``claim_evidence``) is SUPPORTED; only one whose whole basis is
    contradicted is CONTRADICTED.
    """
    rows = basis.join(states, "hypothesis", "left")
    own, s = F.col("role") == "BASIS", F.col("status")
    facts = rows.groupBy("claim_id").agg(F.count_if(own & s.isin("PARTIALLY_SUPPORTED", "SUPPORTED")).alias("good"), F.count_if(own & (s == "CONTRADICTED")).alias("against"), F.count_if(own & s.isNotNull()).alias("known"), F.count_if(~own & (s != "CONTRADICTED")).alias("open"))
    causal = flags.select("claim_id", F.contains("flags", F.lit("CAUSAL_LANGUAGE")).alias("causal"))
    facts = facts.join(causal, "claim_id", "left").join(evidence.select("claim_id", (F.col("support") + F.col("counter") + F.col("neutral")).alias("cited")), "claim_id", "left")
    good, against, known = F.col("good"), F.col("against"), F.col("known")
    conflict = (good > 0) & (against > 0)
    whole = (known > 0) & (good == known)
    status = (
        F.when(known == 0, "UNKNOWN")
        .when(against == known, "CONTRADICTED")
        .when(~whole | (F.col("open") > 0) | F.coalesce("causal", F.lit(False)) | (F.coalesce("cited", F.lit(0)) == 0), "INSUFFICIENT")
        .otherwise("SUPPORTED")
    )
    return facts.select("claim_id", status.alias("status"), F.when(conflict, "CONFLICTING_EVIDENCE").when(whole & (F.col("open") > 0), "COMPETING_EXPLANATION_OPEN").alias("flag"))


def claim_duplicates(claims: DataFrame) -> DataFrame:
    """Claims (claim_id, statement): duplicate_of the first id with the same content; an id with two contents is an error."""
    keyed = claims.select("claim_id", F.sha2(need_key(F.col("statement")).cast("binary"), 256).alias("hash")).distinct()
    clash = keyed.groupBy("claim_id").agg((F.count("*") > 1).alias("clash"))
    first = keyed.groupBy("hash").agg(F.min("claim_id").alias("first"))
    return keyed.join(first, "hash").join(clash, "claim_id").select("claim_id", "hash", F.when(F.col("first") != F.col("claim_id"), F.col("first")).alias("duplicate_of"), F.when(F.col("clash"), "CONFLICTING_CONTENT").alias("error"))


def violations(df: DataFrame, *keys: str, **codes: Column) -> DataFrame:
    """(keys, code): one row for each code whose condition holds; an unknown condition does not."""
    own = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in codes.items()]))
    return df.select(*keys, F.explode(own).alias("code"))


def empty(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def expectation_checks(expectations: DataFrame) -> DataFrame:
    """Violations (id, code) of expectations (id, text, basis, author, created_at, sources, justification, data_seen, frozen,
    criteria); ``sources`` and ``criteria`` are counts. A missing basis is unknown and no violation."""
    basis = F.col("basis")
    return violations(
        expectations,
        "id",
        STATEMENT_REQUIRED=empty("text"),
        UNKNOWN_BASIS=~empty("basis") & ~basis.isin(*BEFORE, *AFTER, *UNTIMED),
        UNKNOWN_AUTHOR=~F.coalesce(F.col("author").isin(*AUTHORS), F.lit(False)),
        CREATED_AT_REQUIRED=F.col("created_at").isNull(),
        SOURCE_REQUIRED=basis.isin(*SOURCED) & (F.coalesce("sources", F.lit(0)) == 0) & empty("justification"),
        PRIOR_AFTER_OBSERVATION=basis.isin(*BEFORE) & F.col("data_seen"),
        POST_HOC_WITHOUT_OBSERVATION=basis.isin(*AFTER) & ~F.col("data_seen"),
        CRITERIA_REQUIRED=F.col("frozen") & (F.coalesce("criteria", F.lit(0)) == 0),
    )


def scenario_validate(scenarios: DataFrame, assumptions: DataFrame, expectations: DataFrame, relations: DataFrame) -> DataFrame:
    """Violations (scenario_id, code) of the rows of scenario sets.

    scenarios: scenario_id, title, as_of, horizon, horizon_end, probability, probability_basis, probability_sources.
    assumptions: scenario_id, assumption_id, statement, kind, as_of, evidence (count). expectations: scenario_id,
    expectation_id, indicator, statement, condition, window_start, window_end, direction, low, high, basis, sources (count),
    data_seen. relations: scenario_id, kind, others (ARRAY of ids). Repeated ids and rows give one row a code.
    """
    end = F.col("window_end")
    own = violations(
        scenarios,
        "scenario_id",
        TITLE_REQUIRED=empty("title"),
        HORIZON_REQUIRED=empty("horizon") | F.col("horizon_end").isNull(),
        HORIZON_BEFORE_BASELINE=F.col("horizon_end") <= F.col("as_of"),
        PROBABILITY_WITHOUT_BASIS=F.col("probability").isNotNull() & (~F.col("probability").between(0, 1) | empty("probability_basis") | (F.coalesce("probability_sources", F.lit(0)) == 0)),
    )
    repeated = scenarios.groupBy("scenario_id").count().filter("count > 1").select("scenario_id", F.lit("DUPLICATE_SCENARIO").alias("code"))
    observed = F.col("kind") == "OBSERVED_BASELINE"
    assumed = violations(
        assumptions,
        "scenario_id",
        ASSUMPTION_INCOMPLETE=F.col("assumption_id").isNull() | empty("statement") | ~F.coalesce(F.col("kind").isin(*ASSUMPTIONS), F.lit(False)) | F.col("as_of").isNull(),
        BASELINE_WITHOUT_EVIDENCE=observed & (F.coalesce("evidence", F.lit(0)) == 0),
        EVIDENCE_FOR_ASSUMPTION=~observed & (F.col("evidence") > 0),
    )
    basis, direction = F.col("basis"), F.coalesce("direction", F.lit(""))
    expected = violations(
        expectations,
        "scenario_id",
        EXPECTATION_INCOMPLETE=F.col("expectation_id").isNull() | empty("indicator") | empty("statement"),
        CONDITION_REQUIRED=empty("condition"),
        BAD_WINDOW=F.col("window_start").isNull() | end.isNull() | (end < F.col("window_start")),
        UNKNOWN_DIRECTION=~direction.isin(*DIRECTIONS),
        RANGE_REQUIRED=(direction == "RANGE") & F.col("low").isNull() & F.col("high").isNull(),
        UNKNOWN_BASIS=~F.coalesce(basis.isin(*BEFORE, *AFTER, *UNTIMED), F.lit(False)),
        SOURCE_REQUIRED=basis.isin(*SOURCED) & (F.coalesce("sources", F.lit(0)) == 0),
        POST_HOC_LEAKAGE=basis.isin(*BEFORE) & F.col("data_seen"),
    )
    twice = expectations.groupBy("expectation_id").agg(F.min("scenario_id").alias("scenario_id"), F.count("*").alias("n")).filter("n > 1").select("scenario_id", F.lit("DUPLICATE_EXPECTATION").alias("code"))
    future = expectations.join(scenarios, "scenario_id").filter(end > F.col("as_of")).select("scenario_id").distinct()
    none = scenarios.join(future, "scenario_id", "left_anti").select("scenario_id", F.lit("NO_FUTURE_EXPECTATION").alias("code"))
    related = violations(relations, "scenario_id", RELATION_TOO_SMALL=F.coalesce(F.size("others"), F.lit(0)) < 1, UNKNOWN_RELATION=~F.coalesce(F.col("kind").isin(*RELATIONS), F.lit(False)))
    named = relations.select("scenario_id", F.explode("others").alias("other"))
    lost = named.join(scenarios.select(F.col("scenario_id").alias("other")).distinct(), "other", "left_anti").select("scenario_id", F.lit("UNKNOWN_SCENARIO").alias("code"))
    out = own
    for part in (repeated, assumed, expected, twice, none, related, lost):
        out = out.unionByName(part)
    return out.distinct()


def scenario_scaffold(hypotheses: DataFrame) -> DataFrame:
    """Hypotheses (id, status, criteria ARRAY) as scenarios' expectations, one a criterion; others are skipped with a reason."""
    skip = F.when(F.col("status") == "CONTRADICTED", "CONTRADICTED").when(F.coalesce(F.size("criteria"), F.lit(0)) <= 0, "NO_CRITERIA")
    rows = hypotheses.withColumn("skipped", skip)
    kept = rows.filter("skipped is null").select("id", F.posexplode("criteria").alias("pos", "criterion"), "skipped")
    return kept.unionByName(rows.filter("skipped is not null").select("id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("criterion"), "skipped"))


def tests(expectations: DataFrame, observations: DataFrame) -> DataFrame:
    """Expectations (expectation_id, scenario_id, window_start, window_end, frozen_at) with their observations
    (expectation_id, outcome, observed_at): scenario_id, expectation_id, outcome, where decisive outcomes outside the window
    or not after the freeze are INCONCLUSIVE."""
    rows = expectations.join(observations, "expectation_id", "left")
    at = F.col("observed_at")
    inside = F.coalesce((at >= F.col("window_start")) & (at <= F.col("window_end")) & (at > F.col("frozen_at")), F.lit(False))
    outcome = F.when(F.col("outcome").isin("CONSISTENT", "CONTRADICTS") & ~inside, "INCONCLUSIVE").otherwise(F.col("outcome"))
    return rows.select("scenario_id", "expectation_id", outcome.alias("outcome"))


def scenario_status(expectations: DataFrame, observations: DataFrame, assumptions: DataFrame, checks: DataFrame) -> DataFrame:
    """(scenario_id, status) from expectations and observations (see ``tests``), the scenarios' assumptions (scenario_id,
    assumption_id) and their checks (scenario_id, assumption_id, result, n).

    CONTRADICTED goes before WEAKENED (the latest check of one of its assumptions says INVALIDATED), CONSISTENT_SO_FAR,
    INCONCLUSIVE, UNTESTED.
    """
    hit = lambda k: F.count_if(F.col("outcome") == k)
    facts = tests(expectations, observations).groupBy("scenario_id").agg(hit("CONTRADICTS").alias("against"), hit("CONSISTENT").alias("fits"), hit("INCONCLUSIVE").alias("unclear"))
    latest = checks.groupBy("scenario_id", "assumption_id").agg(F.max_by("result", "n").alias("result"))
    weak = latest.join(assumptions.select("scenario_id", "assumption_id").distinct(), ["scenario_id", "assumption_id"], "left_semi").filter("result = 'INVALIDATED'").select("scenario_id", F.lit(True).alias("weak")).distinct()
    status = F.when(F.col("against") > 0, "CONTRADICTED").when(F.col("weak"), "WEAKENED").when(F.col("fits") > 0, "CONSISTENT_SO_FAR").when(F.col("unclear") > 0, "INCONCLUSIVE").otherwise("UNTESTED")
    return facts.join(weak, "scenario_id", "left").select("scenario_id", status.alias("status"))


def scenario_requirements(expectations: DataFrame, observations: DataFrame) -> DataFrame:
    """Expectations without a decisive observation inside their window and after their freeze."""
    decisive = tests(expectations, observations).filter(F.col("outcome").isin("CONTRADICTS", "CONSISTENT")).select("expectation_id")
    return expectations.join(decisive, "expectation_id", "left_anti").select("scenario_id", "expectation_id")


def scenario_delta(evaluations: DataFrame, requirements: DataFrame) -> DataFrame:
    """Status of scenarios (scenario_id, eval, status) against the evaluation before, UNTESTED where there is none, and the
    expectations (scenario_id, eval, expectation_id) that need evidence now and did not then."""
    w = Window.partitionBy("scenario_id").orderBy("eval")
    rows = evaluations.withColumn("prev", F.lag("eval").over(w)).withColumn("before", F.coalesce(F.lag("status").over(w), F.lit("UNTESTED")))
    now, then = F.col("status"), F.col("before")
    change = F.when(now == then, "UNCHANGED").when(now == "CONTRADICTED", "CONTRADICTED").when(now == "WEAKENED", "WEAKENED").when(now == "CONSISTENT_SO_FAR", "STRENGTHENED").otherwise("MOVED")
    needs = requirements.select("scenario_id", "eval", "expectation_id").distinct()
    earlier = rows.select("scenario_id", "eval", "prev").join(needs.withColumnRenamed("eval", "prev"), ["scenario_id", "prev"]).drop("prev")
    fresh = needs.join(earlier, ["scenario_id", "eval", "expectation_id"], "left_anti").groupBy("scenario_id", "eval").agg(joined_set(F.col("expectation_id").cast("string")).alias("newly_required"))
    return rows.join(fresh, ["scenario_id", "eval"], "left").select("scenario_id", "eval", "before", "status", change.alias("change"), F.coalesce("newly_required", F.lit("")).alias("newly_required"))


def as_of_monotonic(iterations: DataFrame) -> DataFrame:
    """Iterations (run, seq, as_of) whose as-of lies before the latest earlier one: run, seq, as_of, latest."""
    latest = F.max("as_of").over(Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return iterations.withColumn("latest", latest).filter("as_of < latest").select("run", "seq", "as_of", "latest")


def publication_facts(findings: DataFrame, evidence: DataFrame, iterations: DataFrame, runs: DataFrame) -> DataFrame:
    """Facts for publication, one row a run.

    findings: run, id, basis. evidence: id, type. iterations: run, seq, gaps, unresolved; the latest counts. runs: run, stage,
    mode, hashes, grounded, candidates, limitations, warnings and three human judgments: rivals_considered, status_accurate,
    readiness_honest.
    """
    cited = evidence.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "counter").alias("counter"))
    facts = findings.join(cited, "id", "left").groupBy("run").agg(F.every(F.coalesce("basis", F.lit("")) != "").alias("all_have_basis"), F.every(F.coalesce("n", F.lit(0)) > 0).alias("all_have_evidence"), F.some(F.coalesce("counter", F.lit(0)) > 0).alias("any_counter"))
    latest = iterations.groupBy("run").agg(F.max_by(F.struct("gaps", "unresolved"), "seq").alias("last")).select("run", (F.col("last.gaps") > 0).alias("gaps_disclosed"), (F.col("last.unresolved") > 0).alias("unresolved_disclosed"))
    rows = runs.join(facts, "run", "left").join(latest, "run", "left")
    no = F.lit(False)
    return rows.select("run", *[c for c in runs.columns if c != "run"], *[F.coalesce(c, no).alias(c) for c in ("all_have_basis", "all_have_evidence", "any_counter", "gaps_disclosed", "unresolved_disclosed")])


def publication_checklist(facts: DataFrame) -> DataFrame:
    """(run, unmet, ready): names of the unmet conditions, eleven derived from ``publication_facts`` and three judged by
    people, which are never derived."""
    met = {
        "source_provenance": F.col("hashes"),
        "deterministic": F.col("mode") == "deterministic",
        "grounded": (F.col("candidates") > 0) & (F.col("grounded") == F.col("candidates")),
        "expectation_provenance": F.col("all_have_basis"),
        "stage": ~empty("stage"),
        "evidence": F.col("all_have_evidence"),
        "counter_evidence": F.col("any_counter"),
        "limitations": F.col("limitations"),
        "gaps": F.col("gaps_disclosed"),
        "unresolved": F.col("unresolved_disclosed"),
        "no_mismatch": ~F.col("warnings"),
        "rivals_considered": F.col("rivals_considered"),
        "status_accurate": F.col("status_accurate"),
        "readiness_honest": F.col("readiness_honest"),
    }
    unmet = F.concat_ws(",", *[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in met.items()])
    return facts.select("run", unmet.alias("unmet"), (unmet == "").alias("ready"))


def derive_expectations(findings: DataFrame) -> DataFrame:
    """Expectations of findings (run, seq, id, expectation, frozen), the frozen ones carried to the next iteration too."""
    own = findings.filter(F.coalesce(F.trim("expectation"), F.lit("")) != "").select("run", "seq", "id", "expectation", F.lit(None).cast("int").alias("from_seq"), "frozen")
    last = own.groupBy("run").agg(F.max("seq").alias("last"))
    carried = own.filter("frozen").join(last, "run").filter("seq < last").select("run", (F.col("seq") + 1).alias("seq"), "id", "expectation", F.col("seq").cast("int").alias("from_seq"), "frozen")
    return own.unionByName(carried)


def finding_kind(findings: DataFrame) -> DataFrame:
    """(id, kind) from stage and basis: only an origin from before the data gives a validation result; post-hoc, unknown and
    other origins, and other stages, are exploratory."""
    kind = F.when(F.col("stage") == "SYNTHESIS", "SYNTHESIS").when((F.col("stage") == "VALIDATION") & F.col("basis").isin(*BEFORE), "VALIDATION_RESULT").otherwise("EXPLORATORY_FINDING")
    return findings.select("id", kind.alias("kind"))


def independent_evidence(records: DataFrame) -> DataFrame:
    """Records (id, made_seq, used_seq, unseen, frozen) that are independent, or why not."""
    why = F.when(~F.col("frozen"), "EXPECTATION_NOT_FROZEN").when((F.col("made_seq") == F.col("used_seq")) & ~F.col("unseen"), "SAME_ITERATION")
    return records.select("id", why.isNull().alias("independent"), why.alias("reason"))


def affected_hypotheses(gaps: DataFrame, changes: DataFrame) -> DataFrame:
    """Hypotheses (run, hypothesis) of affected gaps, and those whose status changed."""
    return gaps.select("run", "hypothesis").unionByName(changes.select("run", "hypothesis")).distinct()


def affected_scenarios(scenarios: DataFrame, hypotheses: DataFrame, documents: DataFrame) -> DataFrame:
    """Scenarios (scenario_id, run, hypothesis, doc_id) of the latest set touched by hypotheses or changed documents."""
    by_h = scenarios.join(hypotheses, ["run", "hypothesis"], "left_semi").select("scenario_id")
    by_d = scenarios.join(documents.select("doc_id"), "doc_id", "left_semi").select("scenario_id")
    return by_h.union(by_d).distinct()


def iteration_scenarios(scenarios: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Scenarios with their status of one evaluation, UNTESTED when absent."""
    return scenarios.select("scenario_id").join(evaluation.select("scenario_id", "status"), "scenario_id", "left").select("scenario_id", F.coalesce("status", F.lit("UNTESTED")).alias("status"))


def finding_evidence_split(evidence: DataFrame) -> DataFrame:
    """Per finding of evidence (id, doc_id, type): supporting, counter and neutral documents."""
    part = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == k, F.col("doc_id")))), lambda d: d.cast("string")), ",").alias(k)
    return evidence.groupBy("id").agg(part("support"), part("counter"), part("neutral"))
