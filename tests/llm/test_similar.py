"""Near-dedup by similarity against brute force."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan.llm import similar
from quillspan.llm.common import held


@pytest.mark.parametrize("shard", [1, 4, 2000])
def test_similar_components_match_brute_force(spark, shard):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [None, "", " ", "one", "one", "two words", "A b c d e", "a B c d e"]
    for _ in range(8):
        base = rng.choices(vocabulary, k=rng.choice([30, 120, 900]))
        for _ in range(rng.choice([2, 3, 14])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                own[rng.randrange(len(own))] = f"n{rng.random()}"
            texts.append(" ".join(own))
    ids = [(13 * i) % 997 for i in range(len(texts))]
    sets = [similar.shingle_set(t, 5) for t in texts]
    low = list(range(len(texts)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similar.jaccard(sets[i], sets[j]) >= 0.8:
                low[root(i)] = root(j)
    want = {d: min(e for k, e in enumerate(ids) if root(k) == root(i)) for i, d in enumerate(ids)}
    docs = spark.createDataFrame([(d, t, "x") for d, t in zip(ids, texts, strict=True)], "doc_id long, text string, u string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar.similar_components(docs, shard=shard).collect()}
    assert got == want and len(set(want.values())) < len(ids) - 10
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert similar.keep_one(docs).count() == 0


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(6)
    a, b = (" ".join(rng.choices([f"w{i}" for i in range(300)], k=80)) for _ in range(2))
    rows = [(None, a, "1"), (None, a + " x", "2"), (5, b, "3"), (5, b + " y", "4"), (5, b, "3"), (7, b + " z", "5"), (8, None, "6"), (9, "", "7"), (None, None, "8")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, similar_kept string").withColumn("similar_u", F.lit("clash")).withColumn("root", F.lit("r")).withColumn("u", F.lit(1))
    kept = similar.keep_one(docs)
    got = kept.collect()
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(False, 0), (False, 0), (True, 5), (True, 8), (True, 9)]


@pytest.mark.parametrize("shard", [7, 2000])
def test_texts_that_share_a_passage_but_not_the_representative(spark, shard):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    common = " ".join(rng.choices(words, k=300))
    texts = []
    for _ in range(40):  # half of each text is common; pairs of near copies among them
        own = rng.choices(words, k=200)
        texts += [common + " " + " ".join(own), common + " " + " ".join(own[:-3])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in similar.similar_components(docs, shard=shard).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_fingerprints_of_all_texts_meet_in_trees(spark):
    """SimHash with BK-trees finds a near copy on its own, and pairs of it that are not similar are not linked."""
    rng = random.Random(3)
    base = rng.choices([f"w{i}" for i in range(900)], k=900)
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(rng.choices(base, k=900)), "", None]
    rows = [(i, i, None if not t else similar.sketch(similar.shingle_set(t, 5))) for i, t in enumerate(texts)]
    signed = [(u, d, f if f is None or f < 2**63 else f - 2**64) for u, d, f in rows]
    found = spark.createDataFrame(signed, "u long, doc_id long, fp long")
    assert [tuple(r) for r in similar._tree_pairs(found).collect()] == [(0, 1, 1)]
    same = spark.createDataFrame([(0, "a b c d e f"), (1, "A b c d e f"), (2, "a b c")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar.similar_components(same).collect()} == {0: 0, 1: 0, 2: 2}


def test_tasks_take_bounded_slices_of_batches():
    texts = ["w " * 700_000, None, "", "a b " * 1_000_000, "x", "y z " * 900_000]
    batch = pa.record_batch([pa.array(range(6)), pa.array(range(6)), pa.array(texts)], names=["u", "doc_id", "text"])
    parts = list(held(iter([batch, batch.slice(0, 0)]), most=2_000_000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and [len(p) for p in parts] == [4, 2, 0]
    found = list(similar._bands(5)(iter([batch])))
    assert len(found) > 1 and [u for b in found for u in b.column("u").to_pylist()] == list(range(6))
