"""Edge cases of aggregation, profiling, comparison, text, matching, sources and streams."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillspan.operators import compare, integrity, prepare, profile, research, runs, text
from quillspan.sources import files


def test_values_that_are_no_numbers(spark):
    cells = ["", " NA ", "null", None, "1,234", "-5.5", ".5", "1e3", "1d", "NaN", "Infinity", "12abc", "1_000"]
    got = prepare.parse_values(spark.createDataFrame([(c,) for c in cells], "v string"), "v").collect()
    assert [r.status for r in got] == ["SKIPPED"] * 4 + ["OK"] * 4 + ["INVALID"] * 5
    assert [r.parsed for r in got[4:8]] == [Decimal("1234.000000"), Decimal("-5.500000"), Decimal("0.500000"), Decimal("1000.000000")]


def test_sums_do_not_depend_on_partitions(spark):
    rng = random.Random(0)
    rows = [(f"2024-0{rng.randint(1, 3)}", rng.choice(["0.1", "0.2", "1e10", "-1e10", "x", ""])) for _ in range(500)]
    spec = prepare.Spec((prepare.Metric("s", "sum", "v"), prepare.Metric("m", "mean", "v"), prepare.Metric("n", "count")), (), "p")
    df = spark.createDataFrame(rows, "p string, v string")
    found = [sorted(map(str, prepare.prepare_metrics(df.repartition(n), spec).collect())) for n in (1, 2, 5)]
    assert found[0] == found[1] == found[2]
    assert prepare.prepare_metrics(df.limit(0), spec).count() == 0


def test_types_and_profiles(spark):
    rows = spark.createDataFrame([("1", "2024-01", "true", "", "1.5", "a"), ("NA", "2024/02/03", "FALSE", None, "2", "b"), ("3", "2024-02-03T00:00:00Z", "true", "n/a", "x", "a")], "i string, d string, b string, e string, s string, t string")
    assert {r.name: r.type for r in profile.infer_types(rows).collect()} == {"i": "INTEGER", "d": "DATE", "b": "BOOLEAN", "e": "EMPTY", "s": "STRING", "t": "STRING"}
    got = {r.name: r for r in profile.profile_table(rows).collect()}
    assert (got["i"].nulls, got["i"].low, got["t"].samples, got["e"].non_null) == (1, "1", "a|b", 0)
    assert profile.profile_fingerprint(profile.profile_table(rows)).first() == profile.profile_fingerprint(profile.profile_table(rows.repartition(3))).first()


def test_incomparable_observations_have_no_arithmetic(spark):
    fields = [f for f, _ in compare.INCOMPATIBLE]
    own = [{"value_basis": "real", "origin": "derived"}.get(f, "x") for f in fields]
    rows = [("g", 1, *own, "calendar-year", 2020, 2021, 1, 0.0, "s", False), ("g", 2, *own, "calendar-year", 2021, 2022, 1, 5.0, "t", True), ("g", 3, "y", *own[1:], "calendar-year", 2022, 2023, 1, 6.0, "t", False)]
    df = spark.createDataFrame(rows, ["g", "o", *fields, *compare.PERIOD, "value", "source", "flagged"])
    a, b = sorted(compare.compare_series(df, "g", "o").collect(), key=lambda r: r.o)
    assert (a.absolute, a.relative, a.direction, a.warnings, a.review) == (5.0, None, "increase", "", "ZERO_BASELINE,SOURCE_CHANGED,QUALITY_FLAGS_PRESENT")
    assert (b.absolute, b.direction, b.warnings, b.review) == (None, "unknown", "INCOMPATIBLE_METRIC", "")


def test_budget_skips_what_is_too_large(spark):
    rng = random.Random(1)
    rows = [(p, i, rng.choice([1, 3, 10, 40, 70]), rng.random() < 0.2) for p in "ab" for i in range(60)]
    want = []
    for p in "ab":
        left = 100
        for _, o, n, _ in sorted((r for r in rows if r[0] == p), key=lambda r: (not r[3], r[1])):
            if n <= left:
                left -= n
                want.append((p, o))
    got = text.budget_passages(spark.createDataFrame(rows, "project string, ord int, chars int, protected boolean"), 100)
    assert sorted((r.project, r.ord) for r in got.collect()) == sorted(want)


def test_quotes_are_grounded_with_original_offsets(spark):
    docs = spark.createDataFrame([(1, "Ａｂ「c  d」e"), (2, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, 1, "c  d"), (2, 1, "abCD"), (3, 1, "zz"), (4, 2, "a"), (5, 1, ""), (6, 1, None)], "quote_id long, doc_id long, quote string")
    got = {r.quote_id: (r.start_offset, r.end_offset, r.exact) for r in text.ground_quotes(quotes, docs).collect()}
    assert got == {1: (3, 7, True), 2: (0, 7, False)}


def test_matching_is_greedy(spark):
    rng = random.Random(2)
    pairs = [(a, b, round(rng.random(), 1)) for a in range(12) for b in range(12) if rng.random() < 0.5]
    used_a, used_b, want = set(), set(), []
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.append((a, b, s))
    got = runs.match_pairs(spark.createDataFrame(pairs, "a int, b int, score double")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert runs.match_pairs(spark.createDataFrame([], "a int, b int, score double")).count() == 0


def greedy(pairs):
    used_a, used_b, found = set(), set(), []
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), found.append((a, b, s))
    return sorted(found)


def test_matching_settles_however_many_scores_are_equal(spark):
    pairs = [(a, b, 1.0) for a in range(33) for b in range(33)]
    got = runs.match_pairs(spark.createDataFrame([*pairs, pairs[0], (None, 1, 2.0)], "a int, b int, score double")).collect()
    assert sorted(map(tuple, got)) == greedy(pairs)


def test_titles_match_what_the_spans_leave(spark):
    rng = random.Random(5)
    spans = "finding int, doc_id int, start int, end int"
    a, b = [(1, 0, 0, 10), (2, 0, 20, 30)], [(7, 0, 0, 10), (8, 0, 22, 32)]
    for several in (False, True):
        ta, tb = ([(i, rng.choice("xyz") if i % 9 else None) for i in range(70)] for _ in range(2))
        if several:
            ta, tb = ta[:12] + [(3, "x"), (3, "y")], tb[:12]
        got = runs.match_findings(spark.createDataFrame(a, spans), spark.createDataFrame(b, spans), spark.createDataFrame(ta, "finding int, title string"), spark.createDataFrame(tb, "finding int, title string")).collect()
        want = greedy([(1, 7, 3.0), (2, 8, 1.667)] + [(i, j, 0.5) for i, t in ta for j, u in tb if t and t == u])
        mine = {runs.EXACT: 2, runs.OVERLAP: 1, runs.TITLE: 0}
        assert sorted((r.a, r.b, round(r.score + mine[r.method], 3)) for r in got) == want and any(s == 0.5 for _, _, s in want)


def test_fingerprints_ignore_order_and_ids(spark):
    rows = [("r", "s", f"text {i % 7}", None) for i in range(50)]
    schema = "run string, source string, text string, metadata string"
    a = runs.input_fingerprint(spark.createDataFrame(rows, schema)).first()
    b = runs.input_fingerprint(spark.createDataFrame(rows[::-1], schema).repartition(5)).first()
    c = runs.input_fingerprint(spark.createDataFrame(rows[1:], schema)).first()
    assert a == b and a.fingerprint != c.fingerprint


def test_quarantine_of_odd_csv(spark, tmp_path):
    body = b'\xef\xbb\xbfid,source,title,content\n1,web,t,"two\nlines ""q"""\n2,blog,t,x\n3,web,t," "\n4,web,t\n5,web,t,bad\xff\n6,WEB,,ok\n'
    (tmp_path / "d.csv").write_bytes(body)
    valid, rejects = files.row_quarantine(files.documents_csv_scan(spark, str(tmp_path)))
    assert {r.id: r.content for r in valid.collect()} == {"1": 'two\nlines "q"', "6": "ok"}
    assert {r.id: r.reason for r in rejects.collect()} == {"2": "invalid source", "3": "empty content", "4": "malformed row", "5": "invalid UTF-8"}


def test_raw_files_against_claims(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    good = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    for sha, size, ok in ((good, 3, True), (None, None, True), (good, 4, False), ("0" * 64, None, False)):
        claims = spark.createDataFrame([("f.bin", sha, size)], "file string, sha256 string, size long")
        r = files.raw_file_verify(spark, str(tmp_path / "f.bin"), claims).first()
        assert (r.sha256, r.size, r.verified) == (good, 3, ok)


def test_provenance_never_overwrites(spark):
    docs = spark.createDataFrame([(1, "f", {"file_hash": "mine"}), (2, "g", None)], "id int, file string, metadata map<string,string>")
    stamps = spark.createDataFrame([("f", "h", None)], "file string, file_hash string, source_name string")
    got = {r.id: r.metadata for r in files.provenance_stamp(docs, stamps).collect()}
    assert got == {1: {"file_hash": "mine"}, 2: {}}


def test_copies_are_collapsed_by_content(spark):
    docs = spark.createDataFrame([(3, "s", "x", None), (1, "s", "x", None), (2, "s", "x", "m"), (4, None, None, None)], "id int, source string, content string, metadata string")
    got = {r.id: (r.kept_id, r.copies, r.kept) for r in compare.collapse_copies(docs.withColumn("kept", F.lit("clash"))).collect()}
    assert got == {1: (1, 2, True), 3: (1, 2, False), 2: (2, 1, True), 4: (4, 1, True)}


def test_a_header_of_other_names_is_an_error(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes(b"title,source,id,content\nt,web,1,text\n")
    with pytest.raises(Exception, match="header"):
        files.documents_csv_scan(spark, str(tmp_path)).collect()


def test_characters_that_stand_for_bad_bytes_are_valid(spark, tmp_path):
    (tmp_path / "d.csv").write_text("id,source,title,content\n1,web,t,the sign \ufffd and caf\u00e9\n", encoding="utf-8")
    valid, rejects = files.row_quarantine(files.documents_csv_scan(spark, str(tmp_path)))
    assert [r.content for r in valid.collect()] == ["the sign \ufffd and caf\u00e9"] and rejects.count() == 0


def test_changes_of_hypotheses(spark):
    steps = [("UNTESTED", "INSUFFICIENT_EVIDENCE", "STRENGTHENED"), ("PLAUSIBLE", "PARTIALLY_SUPPORTED", "STRENGTHENED"), ("PARTIALLY_SUPPORTED", "PLAUSIBLE", "WEAKENED"), ("SUPPORTED", "CONTRADICTED", "CONTRADICTED"), ("CONTRADICTED", "CONTRADICTED", "UNCHANGED"), ("CONTRADICTED", "UNTESTED", "WEAKENED"), ("CONTRADICTED", "PLAUSIBLE", "STRENGTHENED")]
    rows = [("r", k, f"T {i}", s) for i, (a, b, _) in enumerate(steps) for k, s in ((1, a), (2, b))]
    got = {r.key: r.change for r in research.hypothesis_evolution(spark.createDataFrame(rows, "run string, seq int, title string, status string")).filter("seq = 2").collect()}
    assert got == {f"t {i}": change for i, (_, _, change) in enumerate(steps)}


def test_plausible_hypotheses_are_neither_supported_nor_strong(spark):
    rows = [("r", 1, "a", "PLAUSIBLE"), ("r", 1, "b", "CONTRADICTED"), ("r", 2, "a", "PARTIALLY_SUPPORTED"), ("r", 2, "b", "PLAUSIBLE"), ("r", 3, "a", "CONTRADICTED")]
    got = {r.seq: tuple(r)[2:] for r in research.hypothesis_summary(spark.createDataFrame(rows, "run string, seq int, title string, status string")).collect()}
    assert got == {1: (1, 0, 0, 1, "a"), 2: (2, 1, 0, 0, "a"), 3: (0, 0, 0, 1, None)}


def test_states_of_claims(spark):
    states = {"s": "SUPPORTED", "p": "PARTIALLY_SUPPORTED", "c": "CONTRADICTED", "m": "PLAUSIBLE", "u": "UNTESTED"}
    cases = {  # basis, competitors, causal, cited evidence: status, flag
        1: ("sp", "", False, 1, "SUPPORTED", None),
        2: ("sc", "", False, 1, "INSUFFICIENT", "CONFLICTING_EVIDENCE"),
        3: ("c", "", False, 1, "CONTRADICTED", None),
        4: ("sm", "", False, 1, "INSUFFICIENT", None),
        5: ("s", "u", False, 1, "INSUFFICIENT", "COMPETING_EXPLANATION_OPEN"),
        6: ("s", "c", False, 1, "SUPPORTED", None),
        7: ("s", "", True, 1, "INSUFFICIENT", None),
        8: ("s", "", False, 0, "INSUFFICIENT", None),
        9: ("x", "", False, 1, "UNKNOWN", None),
    }
    basis = spark.createDataFrame([(i, h, role) for i, (own, other, *_) in cases.items() for hs, role in ((own, "BASIS"), (other, "COMPETING")) for h in hs], "claim_id int, hypothesis string, role string")
    flags = spark.createDataFrame([(i, "CAUSAL_LANGUAGE_WITHOUT_IDENTIFICATION" if c[2] else "") for i, c in cases.items()], "claim_id int, flags string")
    cited = spark.createDataFrame([(i, c[3], 0, 0) for i, c in cases.items() if c[3]], "claim_id int, support int, counter int, neutral int")
    got = {r.claim_id: (r.status, r.flag) for r in research.claim_status(basis, spark.createDataFrame(list(states.items()), "hypothesis string, status string"), flags, cited).collect()}
    assert got == {i: c[4:] for i, c in cases.items()}


def test_scenarios_count_only_what_can_test_them(spark):
    day = datetime.date.fromisoformat
    frozen, low, high = day("2024-01-01"), day("2024-02-01"), day("2024-03-01")
    expectations = spark.createDataFrame([(f"e{i}", f"s{i}", low, high, frozen) for i in range(8)], "expectation_id string, scenario_id string, window_start date, window_end date, frozen_at date")
    seen = [("e0", "CONTRADICTS", "2024-02-10"), ("e1", "CONTRADICTS", "2025-02-10"), ("e2", "CONSISTENT", "2024-02-10"), ("e3", "NOT_OBSERVED", "2024-02-10"), ("e4", "INCONCLUSIVE", "2024-02-10"), ("e5", "CONSISTENT", "2024-02-10"), ("e6", "CONSISTENT", "2024-02-10")]
    observations = spark.createDataFrame([(e, o, day(d)) for e, o, d in seen], "expectation_id string, outcome string, observed_at date")
    assumptions = spark.createDataFrame([("s5", "a"), ("s5", "b"), ("s6", "a")], "scenario_id string, assumption_id string")
    checks = spark.createDataFrame([("s5", "a", "INVALIDATED", 1), ("s5", "b", "HOLDS", 2), ("s6", "a", "INVALIDATED", 1), ("s6", "a", "HOLDS", 2), ("s2", "other", "INVALIDATED", 3)], "scenario_id string, assumption_id string, result string, n int")
    got = {r.scenario_id: r.status for r in research.scenario_status(expectations, observations, assumptions, checks).collect()}
    assert got == {"s0": "CONTRADICTED", "s1": "INCONCLUSIVE", "s2": "CONSISTENT_SO_FAR", "s3": "UNTESTED", "s4": "INCONCLUSIVE", "s5": "WEAKENED", "s6": "CONSISTENT_SO_FAR", "s7": "UNTESTED"}
    open_ones = {r.expectation_id for r in research.scenario_requirements(expectations, observations).collect()}
    assert open_ones == {"e1", "e3", "e4", "e7"}


def test_expectations_of_unknown_origin_are_no_violation(spark):
    schema = "id int, text string, basis string, author string, created_at date, sources int, justification string, data_seen boolean, frozen boolean, criteria int"
    day = datetime.date(2024, 1, 1)
    rows = [(1, "x", None, "HUMAN", day, 0, None, True, False, 0), (2, "x", "PRIOR", "MODEL", day, 0, None, True, False, 0), (3, "x", "HUMAN_POST_HOC", "MODEL", day, 0, None, False, True, 1), (4, "x", "LITERATURE", "MODEL", day, 0, " ", False, True, 0), (5, " ", "guess", "BOT", None, 1, None, None, None, None)]
    got = sorted(tuple(r) for r in research.expectation_checks(spark.createDataFrame(rows, schema)).collect())
    assert got == [(2, "PRIOR_AFTER_OBSERVATION"), (3, "POST_HOC_WITHOUT_OBSERVATION"), (4, "CRITERIA_REQUIRED"), (4, "SOURCE_REQUIRED"), (5, "CREATED_AT_REQUIRED"), (5, "STATEMENT_REQUIRED"), (5, "UNKNOWN_AUTHOR"), (5, "UNKNOWN_BASIS")]


def test_manifests_that_carry_secrets(spark):
    good = ("d", "n", "s", "fixture", "2024-01-01")
    rows = [(*good, {"ideal": "x"}, "http://h/p?year=1#key=2"), (*good, {"app_id": "x"}, None), (*good, {"credential": "x"}, None), (*good, {"id": "x"}, "http://h?sort_key=1"), ("d", "n", "s", "scrape", "2024-01-01", None, None)]
    frame = spark.createDataFrame([(f"d{i}", *r[1:]) for i, r in enumerate(rows)], "dataset_id string, source_name string, schema_id string, method string, retrieved_at string, parameters map<string,string>, url string")
    got = sorted(tuple(r) for r in compare.manifest_validate(frame).collect())
    assert got == [("d1", "CREDENTIAL_PARAMETER"), ("d2", "CREDENTIAL_PARAMETER"), ("d3", "CREDENTIAL_IN_URL"), ("d3", "CREDENTIAL_PARAMETER"), ("d4", "UNKNOWN_METHOD")]


def test_nested_fields_of_configurations(spark):
    pairs = [(1, '{"a": {"x": 1, "y": {"z": [1, 2]}}, "b": "t"}', '{"b": "t", "a": {"y": {"z": [1, 2]}, "x": 1}}'), (2, '{"a": {"x": 1}}', '{"a": {"x": 2, "n": null}, "c": ""}'), (3, "no json", '{"a": "{"}')]
    got = sorted(tuple(r) for r in runs.config_field_diff(spark.createDataFrame(pairs, "id int, a string, b string")).collect())
    assert got == [(2, "a.x", "1", "2"), (3, "a", "", "{")]


def test_equal_coverage_is_no_exact_match(spark):
    spans = "finding int, doc_id int, start int, end int"
    a = spark.createDataFrame([(1, 0, 0, 1000), (2, 1, 0, 5)], spans)
    b = spark.createDataFrame([(7, 0, 0, 500), (7, 0, 500, 1000), (8, 1, 0, 5), (8, 2, 9, 9)], spans)
    none = spark.createDataFrame([], "finding int, title string")
    found = runs.match_findings(a, b, none, none)
    assert {(r.a, r.b): (r.method, r.score) for r in found.collect()} == {(1, 7): (runs.OVERLAP, 1.0), (2, 8): (runs.EXACT, 1.0)}
    fields = "finding int, title string, status string"
    one, other = spark.createDataFrame([(1, "t", "x"), (2, "u", None), (3, "v", "x")], fields), spark.createDataFrame([(7, "T", "y"), (8, "u", ""), (9, "v", "x")], fields)
    got = {(r.a, r.b): (r.method, r.changed) for r in runs.finding_changes(found, one, other, ["title", "status"]).collect()}
    assert got == {(1, 7): (runs.OVERLAP, "status,title"), (2, 8): (runs.EXACT, ""), (3, None): ("REMOVED", None), (None, 9): ("ADDED", None)}


def test_codes_of_pairs(spark):
    fields = "struct<metric_id:string,population:string,filters:string,parameters:string,spec_hash:string,geography:string,value_basis:string,origin:string,dims:string,basis:string,start:int,end:int,windows:int,value:double,source:string,flagged:boolean>"
    base = ("m", "p", "", "", "h", "g", "nominal", "observed", "", "calendar-year", 2020, 2021, 1, 10.0, "s", False)
    later = (*base[:10], 2021, 2022, 1, 8.0, "s", False)
    cases = [(base, later), (base, (*later[:10], 2020, 2021, 1, 8.0, "s", False)), (base, (*later[:3], "q", *later[4:])), (base, (*later[:14], " ", False)), (base, (*later[:13], None, "s", False))]
    got = [(r.direction, r.absolute, r.warnings) for r in compare.compare_pairs(spark.createDataFrame(cases, f"prev {fields}, cur {fields}")).collect()]
    assert got == [("decrease", -2.0, ""), ("unknown", None, "INCOMPATIBLE_PERIOD"), ("unknown", None, "INCOMPATIBLE_PARAMETERS"), ("unknown", None, "INVALID_PROVENANCE"), ("unknown", None, "MISSING_OR_NON_NUMERIC_VALUE")]


def test_an_artifact_without_parts(spark):
    header = "artifact_id int, schema string, version string, producer string, producer_version string, generated_at date, artifact_hash string, subject_namespace string, subject_id string, spec_kind string, spec_reference string, spec_hash string, period_start string, period_end string, population string, engine string, engine_version string, deterministic boolean"
    day, sha = datetime.date(2024, 1, 1), "a" * 64
    good = ("x", "1", "p", "1", day, sha, None, None, "k", "r", sha, "2024-01", "2024-01", "all", "e", "1", True)
    artifacts = spark.createDataFrame([(1, *good), (2, "y", *([None] * 16))], header)
    metrics = spark.createDataFrame([(1, "m", "n", "u")], "artifact_id int, metric_id string, name string, unit string")
    results = spark.createDataFrame([(1, "m", "2024-01", "2024-02", 1.0, False)], "artifact_id int, metric_id string, period_start string, period_end string, value double, missing boolean")
    datasets = spark.createDataFrame([(1, "d", "v", sha)], "artifact_id int, dataset_id string, version string, hash string")
    sources = spark.createDataFrame([(1, "d", "s", day)], "artifact_id int, dataset_id string, source string, retrieved_at date")
    got = {(r.artifact_id, r.code) for r in integrity.validate_artifacts(artifacts, metrics, results, datasets, sources, ("x", "1")).collect()}
    assert got == {(2, c) for c in ("UNSUPPORTED_SCHEMA", "PRODUCER_REQUIRED", "BAD_HASH", "SPEC_REQUIRED", "BAD_SPEC_HASH", "BAD_PERIOD", "POPULATION_REQUIRED", "COMPUTATION_REQUIRED", "DATASETS_REQUIRED", "METRICS_REQUIRED", "RESULTS_REQUIRED", "PROVENANCE_REQUIRED")}
