"""Filter audit, decontamination and resampling against brute force, their SQL and odd rows."""

import glob
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, filter_audit, queries, resample

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """(doc_id, text, lang) with columns of clashing names."""
    frame = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], DOCS)
    for name in ("part", "mask", "sha", "key", "raw", "spans", "items", "n_words", "segment", "score", "rank", "hit_key", "first_sha"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_decontamination", "op13_importance_resampling"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(queries.oracle_sql()[name]).select(*columns).fetchall()
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(str, want)) and want


def slow_masks(rows):
    found = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [j for j, t, _ in rows if (t or "") == text]
        fails = [
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            bool(re.search(r"[#$%&*|]", text)),
            any(j is not None and (i is None or j < i) for j in same),
        ]
        found.append((lang or "", fails))
    return found


def slow_audit(fails, good, toxic):
    rows = {}
    for part in {p for p, _ in fails}:
        own = [(f, g, t) for (p, f), g, t in zip(fails, good, toxic, strict=True) if p == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, letter in enumerate(order, 1):
                k = ord(letter) - 65
                gone = [x for x in left if x[0][k]]
                left = [x for x in left if not x[0][k]]
                shapley[letter] += len(gone)
                rows[part, "".join(order), step] = [len(left), len(gone), sum(x[0][k] for x in own) - len(gone), sum(x[0][k] and sum(x[0]) == 1 for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone), letter]
        for key in [key for key in rows if key[0] == part]:
            rows[key][-1] = shapley[rows[key][-1]]
    return rows


def test_audit_replays_every_order(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta", "GAMMA", "#d", "é"] + [f"w{k}" for k in range(rng.choice([5, 400]))], k=rng.choice([3, 150, 260]))), rng.choice(["en", "fr", None, ""])) for i in range(90)]
    rows += [(200 + i, rows[i % 3][1], rng.choice(["en", "de"])) for i in range(30)]
    rows += [(300, None, "en"), (301, "", "fr"), (None, "", "en"), (None, None, None), (302, " \t\n", "xx"), (303, "Abc $ " * 30_000, "xx"), (5, rows[5][1], "en"), (5, "other", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 320, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    good = [any(j == i and q == 1 for j, q, _ in labels) and i is not None for i, _, _ in rows]
    toxic = [any(j == i and t == 1 for j, _, t in labels) and i is not None for i, _, _ in rows]
    masks = filter_audit.fail_masks(docs(spark, rows).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash")))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(masks, "ABCDE").collect()}
    assert got == slow_audit(slow_masks(rows), good, toxic)
    assert len(got) == 600 * 5


def test_audit_of_no_rows_and_other_filters(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.fail_masks(docs(spark, []), none), "ABCDE").count() == 0
    masks = spark.createDataFrame([("p", 3, True, False), ("p", 1, False, True), ("p", 0, True, True)], "part string, mask int, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(masks, "xy").collect()}
    assert got == {("xy", 1): (1, 2, 0, 1, 1, 1, 3), ("xy", 2): (1, 0, 1, 0, 0, 0, 1), ("yx", 1): (2, 1, 0, 0, 1, 0, 1), ("yx", 2): (1, 1, 1, 1, 0, 1, 3)}
    for letters in ("", "aa", "abcdefg"):
        with pytest.raises(ValueError):
            filter_audit.audit(masks, letters)


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def slow_hits(text, items, n):
    words, hit, names = slow_words(text), set(), set()
    for item, body in items:
        own = slow_words(body)
        size = min(n, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                names.add("" if item is None else str(item))
    return len(words), hit, sorted(names)


def leak_case():
    rng = random.Random(12)
    letters = ["a", "b", "é", "x1", "Ünder"]
    items = [(i, " ".join(rng.choices(letters, k=rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(1, 25)]
    items = [x for x in items if len(x[1].split()) > 2] + [(100, "solo-word, twice"), (None, "null id here"), (7, "one id again with another text of more than ten words in it"), (101, None), (102, " .,- "), (103, "")]
    rows = [(i, ", ".join(rng.choices([*letters, "B", "free", "words"], k=rng.choice([0, 2, 12, 60])))) for i in range(120)]
    rows += [(200, "Say: SOLO word... (twice)\x00 and NULL id\there!"), (201, None), (202, ""), (203, "quiet " * 40_000 + items[0][1]), (None, items[1][1]), (5, items[2][1]), (5, items[2][1]), (204, "xx".join(["One ID again with another text of more than"] * 2) + " ten words in it")]
    return items, rows


@pytest.mark.parametrize("n", [10, 3])
@pytest.mark.parametrize("limits", [{}, {"pairs": 40}, {"size": 900}])
def test_contamination_matches_brute_force(spark, n, limits):
    items, rows = leak_case()
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("clash")).withColumn("words", F.lit(1))
    frame = docs(spark, [(i, t, "en") for i, t in rows]).repartition(3)
    got = sorted(str((r.doc_id, r.n_words, sorted(w for s in r.spans for w in range(s.first, s.last + 1)), list(r["items"]))) for r in decontaminate.contamination(frame, benchmark, n=n, **limits).collect())
    want = [(i, *slow_hits(t, items, n)) for i, t in rows]
    assert got == sorted(str((i, m, sorted(hit), names)) for i, m, hit, names in want)
    assert sum(bool(hit) for _, _, hit, _ in want) > 10


def test_spans_and_documents_are_removed(spark):
    benchmark = spark.createDataFrame([(1, "one two three four"), (2, "zwölf")], "item_id long, text string")
    rows = [(1, "Keep. One, two THREE; four! Keep"), (2, "one two three"), (3, None), (4, "a Zwölf-zwölf b"), (5, ""), (6, "zwölf")]
    frame = docs(spark, [(i, t, "en") for i, t in rows])
    for limits in ({}, {"pairs": 1}):
        got = decontaminate.remove_spans(frame, benchmark, **limits)
        assert got.columns == frame.columns
        assert {r.doc_id: r.text for r in got.collect()} == {1: "Keep. ! Keep", 2: "one two three", 3: None, 4: "a  b", 5: "", 6: ""}
        left = decontaminate.remove_documents(frame, benchmark, **limits)
        assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 5]
        assert sorted(r.doc_id for r in decontaminate.remove_documents(frame, benchmark, least=0.7, **limits).collect()) == [1, 2, 3, 4, 5]


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs(spark, []), none).count() == 0
    r = decontaminate.contamination(docs(spark, [(1, "a b", "en")]), none).first()
    assert (r.n_words, r.spans, r["items"]) == (2, [], [])
    with pytest.raises(ValueError):
        decontaminate.contamination(docs(spark, []), none, n=0)


def test_windows_with_shared_hash_bits_are_verified():
    table = decontaminate.WindowSet([("a b", "1"), ("b a", "2"), ("a", "3"), ("a b", "4")])
    numbers = [table.numbered(t) for t in (b"A b a", b"b", b"", b"b b a c")]
    assert table.hits(numbers) == [([(0, 2)], ["1", "2", "3", "4"]), ([], []), ([], []), ([(1, 2)], ["2", "3"])]
    assert table.hits([]) == []


def slow_draw(rows, target, percent, least, longest, buckets, seed):
    def features(text):
        w = slow_words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    raw, goal = Counter(b for _, t in rows for b in features(t)), Counter(b for t in target for b in features(t))
    s_all, t_all = sum(raw.values()), sum(goal.values())
    found = []
    for i, text in rows:
        own = features(text)
        weight = sum(math.floor(1000 * math.log((goal[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in own)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        found.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(slow_words(text))))
    able = sorted((-x[3], x[0] is None, x[0] or 0, x[1], k) for k, x in enumerate(found) if x[4] >= least)
    ranks = {x[4]: r for r, x in enumerate(able, 1) if r <= percent * len(able) // 100}
    return sorted((*x[:4], ranks.get(k)) for k, x in enumerate(found) if x[0] is not None), sorted(map(str, ((*x[:4], ranks.get(k)) for k, x in enumerate(found))))


@pytest.mark.parametrize("longest, percent, segment", [(1, 10, 1_000_000), (2, 60, 3), (3, 100, 7), (1, 0, 5)])
def test_draw_matches_brute_force(spark, longest, percent, segment):
    rng = random.Random(13)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "Ünï", "A-b"]
    rows = [(i, " ".join(rng.choices(vocabulary[: rng.choice([5, 63])], k=rng.choice([3, 19, 20, 45])))) for i in range(150)]
    rows += [(900, rows[0][1]), (901, None), (902, ""), (None, "w1 " * 30), (903, "w2 w3 " * 40_000), (7, rows[7][1]), (7, "w9 " * 25)]
    target = ["w1 w2 w3 É", None, "w1 " * 50]
    frame = docs(spark, [(i, t, "en") for i, t in rows]).repartition(5)
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(frame, goal, percent=percent, least_words=20, longest=longest, buckets=97, seed=5, segment=segment)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in got.collect()) == slow_draw(rows, target, percent, 20, longest, 97, 5)[1]


def test_draw_from_repeated_rows_and_no_rows(spark):
    goal = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(docs(spark, []), goal).count() == 0
    got = resample.resample(docs(spark, [(1, "a b c", "en")] * 50), goal, percent=50, least_words=1, segment=4).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 26)) and len({r.score for r in got}) == 1


def test_places_are_lexicographic():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 3, (3, 200))
    splitters = np.array(sorted(set(map(tuple, rng.integers(0, 3, (9, 3)).tolist())))).T
    want = [sum(tuple(s) <= tuple(k) for s in splitters.T.tolist()) for k in keys.T.tolist()]
    assert resample.places(keys, splitters).tolist() == want
