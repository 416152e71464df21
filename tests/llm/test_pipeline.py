"""Every stage of the pipeline against brute force on its own input."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken
import tiktoken.load

import corpus_pipeline
from quillspan.llm import langid, queries, similar
from quillspan.llm.mixing import BLOCK_ROWS

SF = "/root/testdata/sf0.001"


def one_of_equal(ids, texts):
    best = {}
    for i in sorted(ids):
        key = "".join(texts[i].split())
        if key not in best or len(texts[best[key]]) < len(texts[i]):
            best[key] = i
    return set(best.values())


def one_of_near(ids, texts):
    left = sorted(ids)
    sets = {i: similar.shingle_set(texts[i], 5) for i in left}
    low = {i: i for i in left}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for k, i in enumerate(left):
        for j in left[:k]:
            if similar.jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {root(i) for i in left}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, 0), (9002, " 1 2 3", "en", "src1", 6), (9003, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(odd)
    first = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "byte_bpe":
            assert out.columns == first.columns
        out.write.parquet(str(tmp_path / name))
        found[name] = docs = spark.read.parquet(str(tmp_path / name))
    rows = {n: f.collect() for n, f in found.items()}
    ids = {n: {r.doc_id for r in rs} for n, rs in rows.items()}
    texts = {r.doc_id: r.text or "" for r in first.collect()}
    judged = {r.doc_id: r for r in langid.languages(first).collect()}
    assert ids["language_id"] == {i for i, r in judged.items() if r.lang_pred != "und" and r.score >= 0.35}
    assert not ids["language_id"] & {9001, 9002, 9003}

    assert ids["exact_dedup"] == one_of_equal(ids["language_id"], texts) and len(rows["exact_dedup"]) == len(ids["exact_dedup"])
    assert ids["near_dedup"] == one_of_near(ids["exact_dedup"], texts) and len(rows["near_dedup"]) == len(ids["near_dedup"])

    assert sorted(map(tuple, rows["mixing"]), key=str) == sorted(map(tuple, rows["near_dedup"]), key=str)
    assert len({r.source for r in rows["mixing"][: 4 * BLOCK_ROWS]}) > 1
    assert {r.doc_id: r.decoded_sha256 for r in rows["byte_bpe"]}.keys() == ids["mixing"]


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    known = {r.doc_id for r in langid.languages(docs).collect() if r.lang_pred != "und" and r.score >= 0.35}
    left = one_of_near(one_of_equal(known, texts), texts)
    ranks = tiktoken.load.load_tiktoken_bpe(public_tokenizers.path(queries.VOCABULARY))
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i in left:
        tokens = library.encode_ordinary(texts[i])
        want[i] = (len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want and len(rows) == len(want) > 50
