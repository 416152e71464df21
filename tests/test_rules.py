"""Rules worked by hand: passages, terms, citations, order of requirements, restatements, manifests, time series."""

import pytest

from quillspan.operators import compare, integrity, research, temporal, text


def test_only_two_line_feeds_cut(spark):
    docs = spark.createDataFrame([(1, "a\n \nb"), (2, "\tc\n　"), (3, "d\r\n\r\ne\n\n\n\nf"), (4, " \n\n\t"), (5, "ghijk"), (6, None)], "doc_id int, text string")
    got = sorted((r.doc_id, r.pos, r.passage) for r in text.split_passages(docs, 3).collect())
    assert got == [(1, 0, "a\n "), (1, 1, "\nb"), (2, 0, "c"), (3, 0, "d"), (3, 1, "e"), (3, 2, "f"), (5, 0, "ghi"), (5, 1, "jk")]


def test_generic_terms_are_folded(spark):
    rows = [(1, "効 率 が「コ ス パ」より"), (2, "ＥＡＳＹ life"), (3, "none"), (4, None)]
    got = {r.id: r.term for r in text.generic_terms(spark.createDataFrame(rows, "id int, text string"), ("コスパ", "効率", "easy")).collect()}
    assert got == {1: "コスパ", 2: "easy", 3: None, 4: None}


def test_passages_without_characters_fit(spark):
    rows = [("p", 1, 60, False), ("p", 2, 0, False), ("p", 3, 50, False), ("q", 4, 0, True)]
    got = {(r.project, r.ord) for r in text.budget_passages(spark.createDataFrame(rows, "project string, ord int, chars int, protected boolean"), 100).collect()}
    assert got == {("p", 1), ("p", 2), ("q", 4)}


def test_claims_that_cite_observations_have_a_basis(spark):
    refs = spark.createDataFrame([("c1", " o1 "), ("c1", " "), ("c2", "d1"), ("c3", "nothing"), ("c4", None), ("c5", "o1"), ("c5", "d1")], "claim_id string, ref string")
    observations = spark.createDataFrame([("o1",)], "id string")
    documents = spark.createDataFrame([("d1", "x"), ("d2", None)], "id string, ext string")
    cited = research.claim_citations(refs, observations, documents)
    assert {(r.claim_id, r.ref): (r.kind, r.doc_id, r.observation_id) for r in cited.collect()} == {
        ("c1", "o1"): ("OBSERVATION", None, "o1"), ("c2", "d1"): ("DOCUMENT", "d1", None), ("c3", "nothing"): ("NOT_FOUND", None, None), ("c5", "o1"): ("OBSERVATION", None, "o1"), ("c5", "d1"): ("DOCUMENT", "d1", None)
    }
    evidence = spark.createDataFrame([("h1", "d2", "o1", "support"), ("h1", "d2", "o9", "counter"), ("h2", "d1", None, "counter"), ("h2", "d1", "o1", "neutral")], "hypothesis string, doc_id string, observation_id string, type string")
    claims = spark.createDataFrame([(f"c{k}",) for k in range(1, 6)], "claim_id string")
    named = spark.createDataFrame([("c2", "h1")], "claim_id string, hypothesis string")
    basis = research.claim_basis(claims, named, cited, evidence)
    assert {(r.claim_id, r.hypothesis, r.role) for r in basis.collect()} == {("c1", "h1", "BASIS"), ("c1", "h2", "BASIS"), ("c2", "h1", "BASIS"), ("c2", "h2", "COMPETING"), ("c5", "h1", "BASIS"), ("c5", "h2", "BASIS")}
    got = {r.claim_id: (r.support, r.counter, r.neutral) for r in research.claim_evidence(basis, cited, evidence).collect()}
    assert got == {"c1": (1, 0, 1), "c5": (1, 1, 1)}  # evidence that is cited twice counts once; c2 cites none of its basis


def test_requirements_that_wait_for_others_come_later(spark):
    gap = "run string, gap_id int, need string, category string, resolvable boolean, resolved boolean, hypothesis string"
    rows = [("r", 1, "a", "COMPARISON", True, False, "h"), ("r", 2, "b", "COMPARISON", False, False, "k"), ("r", 3, "m", "MEASUREMENT", True, False, "h"), ("r", 4, "n", "SOURCE_QUALITY", True, True, "k")]
    states = spark.createDataFrame([("r", "h", True, "SUPPORTED"), ("r", "k", True, "SUPPORTED")], "run string, hypothesis string, identified boolean, validation string")
    got = {r.gap_id: r["rank"] for r in research.rank_requirements(spark.createDataFrame(rows, gap), states).collect()}
    assert got[2] < got[1]  # gap 1 is easier, but waits for gap 3; gap 4 is resolved


def test_restatement_comes_before_the_definition(spark):
    schema = "run int, series string, definition string, period_end string, value double, id int"
    rows = [(1, "a", "v1", "2020", 1.0, 1), (2, "a", "v2", "2020", 2.0, 2), (3, "a", "v3", "2021", 5.0, 3), (1, "b", "v1", "2020", 1.0, 4), (3, "b", "v1", "2021", 9.0, 5), (2, "c", "v1", "2020", 4.0, 6), (3, "c", "v1", "2020", 4.0, 7)]
    got = {(r.run, r.series): (r.kind, r.delta) for r in compare.run_observation_deltas(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(2, "a"): ("RESTATED", None), (3, "a"): ("DEFINITION_CHANGED", None)}  # b skips a run, c says the same


def test_manifests_meet_as_classes(spark):
    schema = "project string, dataset_id string, unit string, population_id string, population string, period string, schema_id string, schema_version string"
    rows = [
        ("p", "d1", "Kg", "", "Adults ", "2021..2024", "s", "1"), ("p", "d2", " kg", None, "adults", "2021", "s", "1"),  # one class
        ("p", "d3", "piece", "", "adults", "2026-01 to 2026-06", "t", "2"), ("p", "d4", "", "A", "children", "spring", "s", " "), ("p", "d5", None, "a", "children", "2021-01-05", "s", "2"),
        ("q", "d6", "x", "", "", "", "", ""),
    ]
    classes = compare.manifest_classes(spark.createDataFrame(rows, schema))
    assert {r.dataset_id: r["class"] for r in classes.collect()} == {"d1": "d1", "d2": "d1", "d3": "d3", "d4": "d4", "d5": "d5", "d6": "d6"}
    got = {(r.a, r.b): (r.pairs, r.warnings) for r in compare.manifest_compatibility(classes).collect()}
    assert got == {
        ("d1", "d3"): (2, "UNIT_MISMATCH,GRANULARITY_MISMATCH"),
        ("d1", "d4"): (2, "POPULATION_MISMATCH"),
        ("d1", "d5"): (2, "POPULATION_MISMATCH,GRANULARITY_MISMATCH,SCHEMA_VERSION_MISMATCH"),
        ("d3", "d4"): (1, "POPULATION_MISMATCH"),
        ("d3", "d5"): (1, "POPULATION_MISMATCH,GRANULARITY_MISMATCH"),
        ("d4", "d5"): (1, "POPULATION_MISMATCH"),  # ids are compared as they are
    }


def test_operations_refuse_other_bases(spark):
    points = spark.createDataFrame([("s", 0, 1.0), ("s", 2, 4.0)], "series string, idx int, value double")
    for call in (lambda: temporal.mom(points, "calendar-year"), lambda: temporal.qoq(points, "calendar-day"), lambda: temporal.cagr(points, "calendar-day")):
        with pytest.raises(ValueError, match="undefined"):
            call()
    ends = spark.createDataFrame([("s", 0, 1.0), ("s", 2, -4.0), ("u", 0, 1.0), ("u", 2, 4.0)], "series string, idx int, value double")
    assert {r.series: (r.value, r.flag) for r in temporal.cagr(ends, "calendar-year").collect()} == {"s": (None, "INTERIOR_GAPS,NON_POSITIVE_ENDPOINT"), "u": (1.0, "INTERIOR_GAPS")}


def test_unknown_is_never_equal(spark):
    names = "id analysis metric_id metric_version result_metric population filters parameters spec_hash geography value_basis origin dims observed_at basis start end windows value source flagged".split()
    kinds = {"start": "int", "end": "int", "windows": "int", "value": "double", "flagged": "boolean"}
    fields = f"struct<{','.join(f'{n}:{kinds.get(n, "string")}' for n in names)}>"
    prev = dict(zip(names, ("o1", "a", "m", "1", "m", "p", '{"x": 1, "y": [1, 2]}', "", "h", "JP", "nominal", "observed", "", "2024-01-01", "calendar-year", 2020, 2021, 1, 10.0, "s", False), strict=True))
    cur = prev | {"id": "o2", "start": 2021, "end": 2022, "value": 12.0, "filters": '{"y": [1, 2], "x": 1}'}
    cases = {
        "": (prev, cur),
        "UNKNOWN_OBSERVATION_OWNERSHIP": (prev, cur | {"analysis": " "}),
        "MISSING_TEMPORAL_EVIDENCE": (None, cur),
        "INCOMPATIBLE_METRIC": (prev | {"metric_version": ""}, cur | {"metric_version": ""}),
        "INCOMPATIBLE_FILTERS": (prev, cur | {"filters": '{"y": [2, 1], "x": 1}'}),
        "MISSING_TEMPORAL_METADATA": tuple(x | {"geography": None, "value_basis": None, "origin": None} for x in (prev, cur)),
        "INVALID_TEMPORAL_EVIDENCE": tuple(x | {"origin": "estimated"} for x in (prev, cur)),
        "INCOMPATIBLE_VALUE_BASIS,INVALID_TEMPORAL_EVIDENCE": (prev, cur | {"value_basis": "bogus"}),
        "INVALID_METRIC_REFERENCE": (prev, cur | {"result_metric": "n"}),
        "NON_FINITE_DELTA": (prev | {"value": -1.7e308}, cur | {"value": 1.7e308}),
    }
    rows = [(w, *[None if x is None else tuple(x[n] for n in names) for x in pair]) for w, pair in cases.items()]
    got = {r.want: (r.warnings, r.absolute) for r in compare.compare_pairs(spark.createDataFrame(rows, f"want string, prev {fields}, cur {fields}")).collect()}
    assert got == {w: (w, None if w else 2.0) for w in cases}


def test_whole_periods_lie_inside_the_artifacts(spark):
    names = "artifact_id string, idx int, observed_at string, geography string, origin string, value_basis string, metric_version string, basis string, start string, finish string"
    good = ("2024-01-01", "JP", "derived", "not_applicable", "1")
    rows = [
        ("a", 1, *good, "calendar-year", "2021", "2022"), ("a", 2, *good, "calendar-year", "2021", "2023"), ("a", 3, *good, "", "2022-12", "2022-12"), ("a", 4, *good, "calendar-day", "2022-12-31", "2022-12-31"),
        ("a", 5, *good, "calendar-day", "2022-02-29", "2022-03-01"), ("a", 6, *good, "calendar-month", "2022-03", "2022-02"), ("a", 7, *good, "fiscal", "2022", "2022"), ("a", 8, *good, "", "2022", "2022"),
        ("a", 9, None, None, None, None, None, "x", "x", "x"), ("a", 10, "", " ", "estimated", None, "", "calendar-month", "2020-12", "2021-01"),
    ]
    headers = spark.createDataFrame([("a", "calendar-month", "2021-01", "2022-12")], "artifact_id string, artifact_basis string, low string, high string")
    got = {}
    for r in integrity.validate_temporal(spark.createDataFrame(rows, names), headers).collect():
        got.setdefault(r.idx, set()).add(r.code)
    assert got == {2: {"OUTSIDE_WINDOW"}, 5: {"BAD_LABEL"}, 6: {"BAD_LABEL"}, 7: {"BAD_LABEL"}, 8: {"BAD_LABEL"}, 10: {"OBSERVED_AT_REQUIRED", "GEOGRAPHY_REQUIRED", "UNKNOWN_ORIGIN", "UNKNOWN_VALUE_BASIS", "METRIC_VERSION_REQUIRED", "OUTSIDE_WINDOW"}}


def test_context_is_counted_by_whole_documents_and_reasons(spark):
    docs = [
        ("p", 1, "alpha beta\n\n---\n\nALPHA  beta\n\ngamma"),  # noise, duplicate; packs to 10 + 2 + 5 = 17
        ("p", 2, "delta delta delta"),  # does not fit behind the others
        ("p", 3, "a limitation"),  # 12, comes first
        ("p", 4, "\n\n"),
        ("p", 5, None),
        ("q", 6, "alpha beta"),  # no duplicate in its own project
        (None, 7, "***"),
    ]
    rows = spark.createDataFrame(docs, "project string, doc_id long, text string")
    got = {r.project: tuple(r)[1:] for r in text.context_stats(rows, 30, 20).collect()}
    assert got == {
        "p": (5, 66, 2, 29, 33, 15, 1, 1, 1),
        "q": (1, 10, 1, 10, 5, 5, 0, 0, 0),
        None: (1, 3, 0, 0, 2, 0, 1, 0, 0),
    }
    assert text.context_stats(rows.limit(0)).collect() == []


def test_a_contexts_texts_are_split_once(spark, monkeypatch):
    seen, written = [], text.written
    monkeypatch.setattr(text, "written", lambda df, name: seen.append(name) or written(df, name))
    rows = spark.createDataFrame([("p", 1, "alpha\n\nbeta"), ("p", 2, "a limitation")], "project string, doc_id long, text string")
    plan = text.context_stats(rows, 30, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert seen == ["context-passages", "context-clean", "context-packs"] and "posexplode" not in plan


def test_only_needs_are_judged_as_needs(spark):
    rows = [(1, "NEEDS", "s"), (2, "GENERAL", "s"), (3, "NEEDS", "　"), (4, None, "s"), (5, "NEEDS", None)]
    findings = spark.createDataFrame([(i, p, s, True, "t", "e", "x", 3) for i, p, s in rows], "id int, profile string, stated string, echo boolean, term string, expectation string, surprising string, competing int")
    got = {r.id: r.flags for r in text.quality_flags(findings, findings.select("id").filter("id <> 2"), "NEEDS").collect()}
    assert got == {1: "STATED_NEED_ECHO,GENERIC_TERM", 2: "NO_DEVIATION_PATTERN", 3: "", 4: "", 5: ""}


def test_confidence_counts_the_documents_of_the_pattern(spark):
    evidence = spark.createDataFrame([("f", 1, "a", "support", 0.8, "p"), ("f", 2, "a", "support", 0.6, "p"), ("f", 3, "b", "counter", 1.0, "p"), ("g", 1, "a", "support", 1.0, "p")], "finding_id string, doc_id int, source string, type string, relevance double, project string")
    total = spark.createDataFrame([("p", 8)], "project string, n long")
    shown = spark.createDataFrame([("f", d) for d in (1, 2, 7, 8, 8)], "finding_id string, doc_id int")
    got = {r.finding_id: r.confidence for r in text.evidence_confidence(evidence, total, shown).collect()}
    assert got == {"f": round((0.35 * 0.7 + 0.25 * 2 / 8 + 0.2 * 1 / 5 + 0.2 * 4 / 5) * 0.9, 6), "g": round(0.35 + 0.25 / 8 + 0.2 / 5, 6)}


def test_searches_count_without_counters_and_flags_by_code(spark):
    rows = [("r", 1, 0, True, True, "B,A"), ("r", 0, 2, False, False, "A"), ("r", 0, 0, None, True, ""), (None, 1, 1, True, True, None)]
    found = spark.createDataFrame(rows, "run string, supports int, counters int, searched boolean, traced boolean, flags string")
    got = {r.run: (r.evidence_coverage, r.counter_coverage, r.mean_evidence, r.flagged_rate, r.flag_counts) for r in text.run_metrics(found).collect()}
    assert got == {"r": (0.333333, 0.333333, 1.0, 0.666667, "A=2,B=1"), None: (1.0, 1.0, 2.0, 0.0, "")}


def test_echo_takes_pairs_of_characters_without_a_function_a_character(spark):
    pairs = [("odd", "abcde", "xbcdeabc", True), ("even", "abcdef", "uvabcwxy", False), ("line", "ab cd", "b cdab", True), ("astral", "a😀b😀c", "😀b😀cz", True), ("short", "abc", "abc", False), ("wide", "ＡＢ ＣＤ", "ab\ncd", True), ("none", None, "abcd", None)]
    rows = text.need_echo(spark.createDataFrame([p[:3] for p in pairs], "id string, stated string, latent string"))
    assert {r.id: r.echo for r in rows.collect()} == {p[0]: p[3] for p in pairs}
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
