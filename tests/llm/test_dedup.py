"""Exact dedup, SimHash near-dedup and components against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspan.llm import exact_dedup, simhash
from quillspan.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " \n\t", "a b c", "a  b\tc", "abc", "A b c", "x " * 20_000, "é" * 5_000, "one", "one", "\x0b\x0c\r"]


def docs(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def brute(texts, ids):
    groups = defaultdict(list)
    for row, (i, t) in enumerate(zip(ids, texts, strict=True)):
        norm = (t or "").encode().translate(None, b" \t\n\x0b\x0c\r")
        groups[norm].append((-len(t or ""), i is None, i or 0, row, i))
    found = []
    for norm, members in groups.items():
        first = min(members)
        found += [(m[4], first[4], len(members), m is first, hashlib.sha256(norm).hexdigest()) for m in members]
    return sorted(found, key=str)


@pytest.mark.parametrize("key_of", [exact_dedup.sha_key, lambda norm, sha: len(norm) % 3 - 1])
@pytest.mark.parametrize("capacity", [1, 4096])
def test_exact_dedup_matches_brute_force(spark, key_of, capacity):
    rng = random.Random(5)
    texts = ODD + ["hot text"] * 60 + ["".join(rng.choices("ab ", k=rng.randint(0, 6))) for _ in range(120)]
    ids = list(range(len(texts)))
    ids[4], ids[5], ids[20], ids[21] = None, 3, 15, 15  # a null id and repeated ones
    frame = docs(spark, texts, ids).withColumn("keep_id", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    got = exact_dedup.exact_dedup(frame, capacity=capacity, key_of=key_of).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(texts, ids)


def test_exact_dedup_of_no_rows(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    assert exact_dedup.drop_copies(docs(spark, [])).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_drop_copies_keeps_one_row_of_each_group(spark):
    frame = docs(spark, ["a b", "ab", "a  b", None, "", "c", "c"], [1, 2, 3, 4, 5, 6, 6]).withColumn("dedup_sha", F.lit("mine"))
    got = exact_dedup.drop_copies(frame)
    assert got.columns == frame.columns
    assert sorted(r.doc_id for r in got.collect()) == [3, 4, 6]


def test_directory_doubles_where_buckets_are_overfull():
    places = exact_dedup.directory({0: 3, 1: 3, 12: 1}, capacity=4, max_depth=4)
    assert len(places) == 16 and places[0] != places[1] and len(set(places[8:])) == 1
    assert exact_dedup.directory({}, capacity=4, max_depth=4) == [0]
    assert len(exact_dedup.directory({7: 100}, capacity=4, max_depth=3)) == 8  # stays overfull at the last depth


def slow_fingerprint(text):
    table = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    words = (text or "").encode().translate(table).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(fps, ids, radius):
    low = list(range(len(fps)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                low[root(i)] = root(j)
    names = defaultdict(list)
    for i, d in enumerate(ids):
        names[root(i)].append(d)
    return [min(names[root(i)]) for i in range(len(fps))]


@pytest.mark.parametrize("shard", [3, 20_000])
def test_simhash_components_match_brute_force(spark, shard):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = list(ODD)
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([3, 40, 400]))
        for _ in range(rng.choice([1, 2, 12])):
            own = list(base)
            own[rng.randrange(len(own))] = "Changed"
            texts.append(" ".join(own))
    ids = [(7 * i) % 1009 for i in range(len(texts))]
    fps = [slow_fingerprint(t) for t in texts]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_components(docs(spark, texts, ids), shard=shard).collect()}
    want = slow_components(fps, ids, 4)
    assert got == {d: (f, c) for d, f, c in zip(ids, fps, want, strict=True)}
    assert len(set(want)) < len(ids) - 10


def test_keep_one_and_no_rows(spark):
    frame = docs(spark, ["same words here for all", "same words here for all", "other words stand in this one", None, ""], [5, 2, 9, 8, 7])
    assert sorted(r.doc_id for r in simhash.keep_one(frame).collect()) == [2, 7, 9]
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_forest_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    points = np.unique(np.r_[(base := rng.integers(0, 2**63, 300, dtype=np.uint64)), base ^ np.uint64(3), base ^ np.uint64(1 << 40)])
    rng.shuffle(points)
    shard = rng.integers(0, 3, len(points))
    forest = simhash.Forest(shard, points)
    got = {p for q, n in forest.search(points, forest.root_of, 4) for p in zip(q.tolist(), n.tolist(), strict=True)}
    near = (np.bitwise_count(points[:, None] ^ points) <= 4) & (shard[:, None] == shard)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_components_of_a_path_a_star_and_self_edges(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500 + i, 499) for i in range(1, 30)] + [(7, 7), (-5, 100)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: -5 for i in [*range(100, 141), -5]} | {i: 499 for i in range(499, 530) if i != 500}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_with_odd_rows(spark):
    texts = ["a b c d e", "a b c d e", "A B c d e", None, "", "x " * 30_000, "x " * 30_000]
    ids = [4, 4, 2, None, 9, 7, None]
    frame = docs(spark, texts, ids)
    for name in ("fp", "component_id", "root", "low", "node"):
        frame = frame.withColumn(name, F.lit("clash"))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(frame).collect()), key=str)
    assert got == sorted([(4, 2), (4, 2), (2, 2), (None, 9), (9, 9), (7, 7), (None, 7)], key=str)


def test_components_of_nodes_with_many_edges(spark, monkeypatch):
    from quillspan.llm import components

    monkeypatch.setattr(components, "LEAST_HOT", 4)
    rng = random.Random(8)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1060)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)] + [(5000, 299), (5, 5)]
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {x: r for x, r in low.items() if (x in got)} and len(got) >= len(low) - 1
