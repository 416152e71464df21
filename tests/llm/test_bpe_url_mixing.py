"""Byte-level BPE against the public library, URL verdicts and mixing against brute force."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillspan.llm import bpe, mixing, queries, url_filter

CONTENT = queries.vocabulary()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, CONTENT.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def test_encoder_matches_the_library():
    rng = random.Random(1)
    letters = [*"abstrevlmd'''  \n\t\r 019.,!é漢  ß😀²Ⅷ́", "'s", "'re", "'ll", " 't", "\x1c", "\x85", "<|endoftext|>"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "a" * 1000, "ab" * 700 + "'s", "x\n", "é" * 900, "'", "'l", "a'", " ", "\n\n"]
    assert bpe.Encoder(bpe.BytePairs.read(CONTENT)).encode(texts) == [as_bytes(LIBRARY.encode_ordinary(t)) for t in texts]


def test_encoder_matches_the_library_on_every_code_point():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    encoder = bpe.Encoder(bpe.BytePairs.read(CONTENT))
    texts = [f"a{chr(c)}a {chr(c)}b1{chr(c)}" for c in points]
    for at in range(0, len(texts), 100_000):
        part = texts[at : at + 100_000]
        want = [as_bytes(x) for x in LIBRARY.encode_ordinary_batch(part)]
        assert [hex(points[at + i]) for i, (a, b) in enumerate(zip(encoder.encode(part), want, strict=True)) if a != b] == []


def test_digests_encode_and_decode(spark):
    texts = ["", None, "Some text, and more.", "é" * 400, "w" * 20_000, "twice", "twice"]
    docs = spark.createDataFrame([(i % 6, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digests(docs, CONTENT).collect()), key=str)
    want = [(i % 6, len(ids := LIBRARY.encode_ordinary(t or "")), hashlib.sha256(as_bytes(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(texts)]
    assert got == sorted(want, key=str)
    round_trip = bpe.decode(bpe.encode(docs, CONTENT), CONTENT).collect()
    assert sorted((r.doc_id, bytes(r.raw)) for r in round_trip) == sorted((i % 6, (t or "").encode()) for i, t in enumerate(texts))
    assert bpe.digests(docs.limit(0), CONTENT).count() == 0


def test_url_verdicts_match_brute_force(spark):
    rng = random.Random(2)
    hosts = ["org", "example.org", "a.example.org", "com", "x.com", "y.x.com", "net", "xcom", "com.", ".com", ""]
    paths = ["", "/", "/fr", "/fr/", "/fr/1", "/fr/1/2", "/de/", "/\U0010ffff", "/fr/\x01"]
    urls = [None, "", "no scheme", "://", "http://A.Example.ORG/fr/1?x=/de/", "http://x.com#/fr/", "http://a\nb.com/fr/"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', '#f'])}" for _ in range(400)]
    urls += ["http://hot.com/fr/"] * 200 + ["http://" + "a." * 3000 + "org/" + "p/" * 20_000, "http://example.org/fr/" + "x" * 100_000 + "?q"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in {(rng.choice(hosts[:7]), rng.choice(paths)) for _ in range(25)}]
    pages = spark.createDataFrame([(None if i == 9 else i // 2, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")

    def judge(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min(rest.index(c) if c in rest else len(rest) for c in "/?#")
            host, rest = rest[:end].lower(), rest[end:]
            path = rest[: min(rest.index(c) if c in rest else len(rest) for c in "?#")]
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    want = Counter((None if i == 9 else i // 2, *judge(u)) for i, u in enumerate(urls))
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    for copies in (url_filter.RULE_COPIES, 20):
        assert Counter(map(tuple, url_filter.url_verdicts(pages, frame, rule_copies=copies).collect())) == want
    assert url_filter.url_verdicts(pages, frame.limit(0)).filter("verdict <> 'allow' or rule is not null").count() == 0
    assert url_filter.url_verdicts(pages.limit(0), frame).count() == 0


def earliest_deadline_first(weights, sizes, block_rows):
    """{(source, block): slot} by simulation, slot after slot."""
    total = sum(weights.values())
    left = {s: -(-n // block_rows) for s, n in sizes.items() if n}
    done, found, slot = dict.fromkeys(left, 0), {}, 0
    while any(done[s] < n for s, n in left.items()):
        free = [(-(-(done[s] + 1) * total // weights[s]), s or "", s) for s, n in left.items() if done[s] < n and done[s] * total // weights[s] <= slot]
        if free:
            s = min(free, key=lambda x: x[:2])[2]
            found[s, done[s]] = slot
            done[s] += 1
        slot += 1
    return found


@pytest.mark.parametrize("leaf", [3, 256])
def test_mixing_is_earliest_deadline_first(spark, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "RANGE", 7)  # several ranges of slots
    sizes = {"hot": 900, "b": 300, "c": 150, "d": 90, None: 40, "e": 1}
    weights = {"hot": 500, "b": 211, "c": 137, "d": 89, None: 71, "e": 3, "absent": 2}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string").withColumn("slot", F.lit("clash"))
    shares = spark.createDataFrame(list(weights.items()), "source string, weight long")
    got = mixing.mix(docs, shares, block_rows=4, leaf=leaf).collect()
    assert sorted(r.doc_id for r in got) == list(range(sum(sizes.values())))
    assert len({r.position for r in got}) == len(got)
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert {(r.source, r.block): r.slot for r in got} == earliest_deadline_first(weights, sizes, 4)


def test_thousands_of_uneven_sources_stay_within_a_block(spark):
    rng = random.Random(3)
    weights = {f"s{i:04}": rng.choice([1, 7, 90, 1000, 40_000]) for i in range(4999)} | {"hot": 30_000_000}
    total = sum(weights.values())
    sources = spark.createDataFrame([(s, w, 3000 if s == "hot" else 1) for s, w in weights.items()], "source string, weight long, blocks long")
    got = mixing.schedule(sources, total).collect()
    assert len(got) == 7999 and len({r.slot for r in got}) == 7999
    assert all(r.release == r.block * total // weights[r.source] and r.deadline == -(-(r.block + 1) * total // weights[r.source]) for r in got)
    # In its window, every block keeps its source less than one block from its share at every slot.
    assert all(r.release <= r.slot < r.deadline for r in got)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None)], "doc_id long, source string")
    assert mixing.mix(docs, mixing.root_weights(docs)).count() == 4
    empty = docs.limit(0)
    assert mixing.mix(empty, mixing.root_weights(empty)).count() == 0
    clash = docs.withColumn("mix_position", F.lit("x")).withColumn("mixat", F.lit("y"))
    kept = mixing.in_mixed_order(clash, mixing.root_weights(docs))
    assert kept.columns == clash.columns and kept.count() == 4
    with pytest.raises(ValueError, match="1 sources"):
        mixing.mix(docs, docs.limit(0).select("source", F.lit(1).alias("weight")).union(spark.createDataFrame([("a", 2)], "source string, weight int")))
