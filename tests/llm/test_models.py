"""HTML extraction, nearest neighbours, LM scoring, language ID and toxicity: brute force, proper sums, held-out accuracy."""

import html
import math
import random
import re
import time
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan.llm import html_text, langid, lm, toxicity, vptree

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, langs=None, ids=None):
    n = len(texts)
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in zip(ids or range(n), texts, langs or [None] * n, strict=True)], DOCS)


# -- HTML ---------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="sidebar-left"><nav><ul><li><a href=/>Home</a></ul></nav>
<header>Site</header><div class="cookie-notice">We use cookies and more words</div><div id="content"><h1 class="header">Title &amp;
 more</h1><p>First  paragraph with <b>bold</b>, a <a href="x">link</a> and enough words to count.<p>Second &lt;one&gt; x &#233;&nbsp;y<br>after a break
<script>var a = "</p><p>no</p>";</script><div class="ad">Buy this now</div><div class="cookiebar">Accept</div><form><input value="v">Search</form><p>Last one of this page here.</p></div>
<section class="comments"><p>A reader says many things about this page</p></section><aside>Related words</aside><footer>end</footer>"""


def test_extracts_the_article_without_marks():
    want = "Title & more\nFirst paragraph with bold, a link and enough words to count.\nSecond <one> x é y\nafter a break\nLast one of this page here."
    assert html_text.main_text(PAGE, html_text.Weights()) == want


def plain_article(page):
    """The article's lines, read with plain patterns: the test tables hold <h1>, <p>, <br>, <b> and character references."""
    inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    lines = re.split(r"</?(?:h1|p|br)[^>]*>", re.sub(r"(?s)<!--.*?-->|</?b>", "", inner))
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in lines) if t)


def test_articles_match_plain_patterns(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {r.page_id: plain_article(r.html) for r in pages.collect()}


def test_the_scan_finds_the_article_without_marks(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = html_text.learn(pages)
    for r in pages.collect():
        bare = re.sub(r"</?article>", "", r.html)
        every, found = html_text.blocks(bare), html_text.content(bare, weights)
        assert "\n".join(b.text for b in found) == plain_article(r.html)  # the bounds alone, no list
        assert len(every) - len(found) >= 3  # a menu, an advert and a footer at least


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p class="advert">Buy</p><p>Some text of the page</p><p hidden>no</p>', "Some text of the page"),
        ('<p>Read <span class="advert">Buy <span>now</span> cheap stuff</span>this line to its end</p>', "Read this line to its end"),
        ("<p>Some text of the page</p><div class=\"ad\" data-u=/x/>Buy this</div><p>and more of the text</p>", "Some text of the page\nand more of the text"),
        ('<div class="post-header-form"><p>Some text of the page</p></div>', "Some text of the page"),
        ('<div class="content has-sidebar"><p>Some text of the page</p></div>', "Some text of the page"),
        ('<main><article><p>The article itself and its words</p></article><section class="comments"><p>I like it</p></section></main>', "The article itself and its words"),
        ("<figure><img src=x><figcaption>A caption of the figure</figcaption></figure><p>Some text of the page</p>", "A caption of the figure\nSome text of the page"),
        ('<div class="site-footer"><p>All rights of this page are reserved</p></div>', ""),
    ],
)
def test_marks_of_boilerplate(page, want):
    assert html_text.main_text(page, html_text.Weights()) == want


ARTICLE = "<h1>A title here</h1><p>" + " ".join(f"word{i}" for i in range(60)) + "</p>"


@pytest.mark.parametrize("attribute", ['style="overflow:hidden"', 'class="overflow-hidden"', 'class="hidden-print"', 'title="the hidden valley"', "aria-label='hidden gems'", "data-hidden=x", 'aria-hidden="false"'])
def test_only_the_attribute_hides(attribute):
    assert html_text.main_text(f"<body><div {attribute}>{ARTICLE}</div>", html_text.Weights()).startswith("A title here\nword0 ")


@pytest.mark.parametrize("attribute", ["hidden", 'HIDDEN=""', 'style="color:red; display: none"', "aria-hidden=true"])
def test_hidden_elements_have_no_text(attribute):
    assert html_text.main_text(f"<body><div {attribute}>{ARTICLE}</div>", html_text.Weights()) == ""


def test_links_at_the_edges_of_the_container_stay():
    page = f'<body><ul><li><a href=/>Home</a></ul><div><p><a>By Jane Doe</a></p>{ARTICLE}<p><a>Read the source paper here</a></p><ul><li><a>one ref</a><li><a>two ref</a></ul><div class="related"><a>Other</a></div></div><div><a>Other site</a></div>'
    lines = html_text.main_text(page, html_text.Weights()).split("\n")
    assert lines[0] == "By Jane Doe" and lines[3:] == ["Read the source paper here", "one ref", "two ref"]


def test_classes_cut_nothing_out_of_a_sentence():
    page = f"<div>{ARTICLE}<p>See <a class='related'>the linked words</a> in <span class='comment'>this</span> <math><mi>x</mi></math> and <button>press</button> it.</p><p class='share'>Plain words of a paragraph</p><p class='share'><a>Share this</a> now</p></div>"
    assert html_text.main_text(page, html_text.Weights()).split("\n")[2:] == ["See the linked words in this x and press it.", "Plain words of a paragraph"]


def test_hostile_pages_take_linear_time():
    began = time.process_time()
    page = "<div>" * 50_000 + "</b2>" * 100_000 + "</section>" * 50_000 + "words of the page"
    assert html_text.main_text(page, html_text.Weights()) == "words of the page"
    assert time.process_time() - began < 5


def test_region_scores_match_brute_force():
    weights = html_text.Weights(0.8, -0.4, {"p": -0.2, "div.ad": -5.0})
    page = '<nav><a href=/>Home</a></nav><div class="ad">Buy this now</div><h1>Title here</h1><p>Some words of <a href=x>linked text</a> here</p><footer>All rights</footer>'
    every = html_text.blocks(page)
    scores = [weights.score(b) for b in every]
    # nav -1.5 (listed), a -0.5, one linked word; ad -5; h1 -0.5 and two words; p -0.2, a -0.5, four words and two linked; footer -1.5
    assert np.allclose(scores, [-2.4, -5.0, 1.1, 1.7, -1.5])
    best = max(((i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda x: sum(scores[x[0] : x[1]]))
    assert html_text.content(page, weights) == every[best[0] : best[1]]


def test_odd_pages(spark):
    texts = [None, "", "plain words only", "<", "<p>a < b", "<p>" + "w " * 50_000, "<!-- open", "<script>x", "<p>&#xD800;&#0;", "</p></div>text", PAGE, PAGE]
    pages = spark.createDataFrame([(None if i == 2 else i // 2, None, t, "clash") for i, t in enumerate(texts)], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert len(rows) == len(texts) and all(r.n_chars == len(r.text) for r in rows)
    assert {r.text for r in rows} >= {"", "plain words only", "a < b", "text"}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_region_is_the_best_run():
    rng = random.Random(6)
    for _ in range(300):
        scores = [rng.randint(-5, 5) for _ in range(rng.randint(1, 12))]
        a, b = html_text.region(scores)
        assert sum(scores[a:b]) == max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))


# -- nearest neighbours -------------------------------------------------------------------------------------------------


def brute_nearest(rows, k):
    ok = [(i, np.array(v, float)) for i, v in dict.fromkeys((i, None if v is None else tuple(v)) for i, v in rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    found = []
    for q, a in ok:
        if q % 50:
            continue
        near = sorted((-float(np.einsum("d,d->", a, b) / (np.sqrt(np.einsum("d,d->", a, a)) * np.sqrt(np.einsum("d,d->", b, b)))), i) for i, b in ok if i != q and len(a) == len(b))
        found += [(q, r + 1, i, round(-s, 12)) for r, (s, i) in enumerate(near[:k])]
    return sorted(found)


@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_nearest_with_factor_one_is_exact(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(vptree, "LEAF", 4)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(260)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(300, 420)]  # a vector that very many rows have
    rows += [(500, None), (501, []), (550, [0.0] * 6), (551, [float("nan")] + [1.0] * 5), (552, [None] + [1.0] * 5), (600, [1.0, 2.0]), (None, [1.0] * 6), (50, rows[50][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = vptree.nearest(frame, frame.filter("vec_id % 50 = 0"), k=5, shard_rows=shard_rows).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in got) == brute_nearest(floats, 5)
    assert vptree.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_recall_of_the_relaxed_search(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = vectors.filter("vec_id % 50 = 0")
    ids = lambda factor: {(r.query_id, r.vec_id) for r in vptree.nearest(vectors, queries, factor=factor).collect()}
    exact = ids(1.0)
    assert len(ids(1.1) & exact) >= 0.95 * len(exact)


# -- language model -----------------------------------------------------------------------------------------------------


def test_base_scores_match_brute_force_and_the_model_beats_them(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs_of(spark, ["", None, "NewWord newword the", "x " * 3000], ids=[10_001, 10_002, 10_003, None])
    rows = docs.unionByName(extra).collect()
    held = {r.doc_id: r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows}
    split = {r.doc_id: [*(r.text or "").encode().lower().split(), b""] for r in rows}
    counts = Counter(w for i, words in split.items() if not held[i] for w in words)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm.score(docs.unionByName(extra).withColumn("n", F.lit("clash")), fitted=700).collect()}
    assert len(got) == len(rows)
    for i, words in split.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words), sum(counts[w] > 0 for w in words), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    mine = [got[i] for i in held if held[i]]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine) * 0.95


def slow_scores(model, counts, texts):
    """log10 probabilities by plain sums, a token at a time."""
    found = []
    units_n, units_v = Counter(), Counter()
    unit = lambda w: model.ids[w] if model.ids.get(w, lm.OWN) < lm.OWN else lm.OWN + lm._ending(w)
    for w, n in counts.items():
        units_n[unit(w)] += n
        units_v[unit(w)] += 1
    for text in texts:
        words = [*lm.words_of(text), lm.END]
        marks = np.array([model.ids.get(w, -2 - unit(w)) for w in words])
        units = np.array([unit(w) for w in words])
        total = 0.0
        for i, w in enumerate(words):
            outer, inner = (x[-1] for x in lm.features(model.unit_class[units[: i + 1]], marks[: i + 1], np.array([0]), len(model.bias)))
            z = model.bias.astype(float) + sum(model.weights[r].astype(float) for r in outer)
            y = sum(model.inner[r].astype(float) for r in inner)
            u = units[i]
            p = math.exp(z[model.unit_class[u]]) / np.exp(z).sum() * math.exp(y[model.unit_member[u]]) / np.exp(y).sum()
            if u >= lm.OWN:
                p *= (counts[w] + 0.5) / (units_n[u] + 0.5 * (units_v[u] + 1))
            total += math.log10(p)
        found.append(total)
    return found


def test_scores_match_a_slow_model(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}x{i % 7}" for i in range(4000)]  # some are frequent, some known to all tasks, some joined
    texts = [None, "unseen w1x1 words", "w5x5 " * 400, "w5x5 " * 400]
    texts += [" ".join(rng.choices(vocabulary, weights=range(4000, 0, -1), k=rng.randint(0, 60))) for _ in range(600)]
    docs = docs_of(spark, texts)
    model, counts = lm.train(docs.filter(lm.fold(F.col("doc_id")) != 1), top=2500)
    counts = Counter({bytes(r.word): r.n for r in counts.collect()})
    assert len(counts) > 2500 and len(model.ids) > lm.OWN
    got = {r.doc_id: r.score for r in lm.score(docs, top=2500).collect()}
    want = slow_scores(model, counts, texts[:60])
    assert np.abs(model.weights).max() > 0 and np.abs(model.inner[len(model.bias) :]).max() > 0
    assert all(abs(got[i] - w) < 1e-3 * max(1, abs(w)) for i, w in enumerate(want))


def test_the_models_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    classes, members = lm.classes_of(rng.integers(0, 3, 40), rng.random(40), 6)
    assert len({*zip(classes.tolist(), members.tolist(), strict=True)}) == 40 and members.max() < 6
    c = int(classes.max()) + 1
    weights, bias = rng.normal(size=(1 << lm.BITS, c)).astype(np.float32), rng.normal(size=c).astype(np.float32)
    inner = rng.normal(size=(c + (1 << lm.BITS), 6)).astype(np.float32)
    inner[:c] = -30
    inner[classes, members] = 0
    units, marks = np.array([1, 2, 3, 1]), np.array([5, 6, 7, 8])
    outer_rows, inner_rows = lm.features(classes[units], marks, np.array([0, 2]), c)
    of_class = np.exp(lm.log_softmax(weights, bias, outer_rows))
    total = np.zeros(4)
    for k in range(c):  # each class with its own members
        rows = lm.features(np.r_[classes[units][:3], k], marks, np.array([0, 2]), c)[1][3:]
        total[3] += of_class[3, k] * np.exp(lm.log_softmax(inner, np.zeros(6, np.float32), rows))[0, members[classes == k]].sum()
    assert np.allclose(of_class.sum(1), 1, atol=1e-5) and abs(total[3] - 1) < 1e-4
    again = lm.features(classes[units][2:], marks[2:], np.array([0]), c)
    assert (outer_rows[2:] == again[0]).all() and (inner_rows[2:] == again[1]).all()  # texts don't see each other


def test_every_training_text_is_learned_from(spark, monkeypatch):
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id") % 97).alias("text"))
    counted, seen = [], []
    cluster, fit_round = lm.cluster, lm.fit_round
    monkeypatch.setattr(lm, "cluster", lambda table, sizes, groups: counted.append(table[:, lm.NEIGHBOURS :].sum()) or cluster(table, sizes, groups))
    monkeypatch.setattr(lm, "fit_round", lambda *x: seen.append(fit_round(*x)))
    model, _ = lm.train(docs)
    assert model.tokens == 6 * 12_000 and seen == [model.tokens] * lm.ROUNDS
    assert 0 <= model.tokens - counted[0] < 16  # a slice's first token has none before it


def test_sums_of_rows_match_brute_force():
    rng = np.random.default_rng(4)
    rows, g = rng.integers(0, 40, (300, 6)) * rng.integers(0, 400, (300, 6)), rng.normal(size=(300, 5)).astype(np.float32)
    want = np.zeros((1 << lm.BITS, 5))
    for k in range(6):
        np.add.at(want, rows[:, k], g)
    used, sums = lm.row_sums(rows, g)
    assert sorted(used) == np.unique(rows).tolist() and np.allclose(want[used], sums, atol=1e-4)


def test_lm_without_texts(spark):
    assert lm.score(docs_of(spark, [])).count() == 0


# -- language ID --------------------------------------------------------------------------------------------------------


def test_language_id_is_accurate_and_labels_switched_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.languages(docs, model).filter("held_out").collect()
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    by = {r.lang: " ".join((r.text or "").split()[:60]) for r in docs.collect()}
    (lang, p), (_, q) = model.predict([by["en"], by["en"] + " " + by["de"]])
    assert lang == "en" and p > 0.9 and 0.25 < q < 0.9


def test_language_id_edges(spark):
    texts = ["", None, " 12 | 34", "the " * 30_000, "a", "日本語", "the cat", "the cat"]
    docs = docs_of(spark, texts, ["en", None, None, "en", "en", "ja", "en", "en"], [1, 2, 3, 4, None, 6, 7, 7]).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.languages(docs).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[None].held_out is False and got[4].lang_pred in {"en", "ja"}
    assert langid.keep_known(docs).columns == docs.columns
    nothing = docs_of(spark, ["words"])
    assert [r.lang_pred for r in langid.languages(nothing).collect()] == ["und"]
    assert langid.languages(nothing.limit(0)).count() == 0


def test_texts_of_signs_and_digits_have_no_language(spark):
    signs = ["\u2014", "\u2026 \u20ac", "\U0001f600 \U0001f600", "\u3002", "\u0661\u0662\u0663", "\u201c12\u201d", "\u0301"]
    texts = [*signs, "the \u2014 cat \u20ac", "日本語。", "हिन्दी।"] + ["the cat and the dog", "der Hund und die Katze"] * 5
    langs = [None] * len(signs) + ["en", "ja", "hi"] + ["en", "de"] * 5
    docs = docs_of(spark, texts, langs)
    model = langid.learn(docs)
    got = {r.doc_id: r for r in langid.languages(docs, model).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in range(len(signs))] == [("und", 0.0)] * len(signs)
    assert all(got[i].lang_pred != "und" for i in range(len(signs), len(texts)))
    assert (model.indices(langid.words_of("the \u2014 cat \u20ac")) > 0).tolist() == [True, False, True, False]
    kept = {r.doc_id for r in langid.keep_known(docs, 0.0).collect()}
    assert kept == set(range(len(signs), len(texts)))
    assert [langid.core_of(w.encode()).decode() for w in ("\u201cwort\u201d,", "日本語。", "हिन्दी।", "a1")] == ["wort", "日本語", "हिन्दी", "a"]


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(3)
    e, moves = rng.normal(size=(4, 1, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    weight = np.zeros((3,) * 4)
    for path in np.ndindex(weight.shape):
        weight[path] = math.exp(sum(e[t, 0, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
    weight /= weight.sum()
    for t, _, p, pairs in langid.forward_backward(e, np.array([4]), moves):
        assert np.allclose(p[0], weight.sum(tuple(i for i in range(4) if i != t)), atol=1e-5)
        if pairs is not None:
            assert np.allclose(pairs[0], weight.sum(tuple(i for i in range(4) if i not in (t, t + 1))), atol=1e-5)


# -- toxicity -----------------------------------------------------------------------------------------------------------


def test_toxicity_finds_what_it_was_not_told(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(400)]
    texts, toxic = [], []
    for i in range(2500):
        own = rng.choices(words, k=60)
        if i % 10 == 0:
            own[rng.randrange(60)] = rng.choice(["badzap", "uglybop", "stemmo" + rng.choice("abcdef"), "badzap."])
        texts.append(" ".join(own))
        toxic.append(int(i % 10 == 0))
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic) if i % 3], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).filter("held_out").collect()
    right = [r.predicted == toxic[r.doc_id] for r in got]
    assert np.mean(right) > 0.98 and np.mean([r.predicted for r in got if toxic[r.doc_id]]) > 0.9


def test_toxicity_edges(spark):
    docs = docs_of(spark, ["", None, "fine", "fine", "bad " * 20_000], ids=[1, 2, None, 3, 3]).withColumn("score", F.lit("clash"))
    for rows in ([], [(1, 0, None), (None, 0, 1)], [(3, 0, 1), (3, 0, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        got = toxicity.toxicity(docs, labels).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_the_risk_and_its_slope():
    rng = np.random.default_rng(5)
    xp, xu = (rng.integers(0, 2, (n, 6)).astype(np.float32) for n in (30, 50))
    loss = lambda z: np.log1p(np.exp(-z))
    branches = set()
    for scale, prior in ((0.3, 0.2), (2.0, 0.9), (3.0, 0.95), (1.0, 0.5)):
        w = rng.normal(size=7) * scale
        score = lambda x, w: x.astype(float) @ w[:-1] + w[-1]
        confirmed = lambda w: prior * loss(score(xp, w)).mean()
        clean = lambda w: loss(-score(xu, w)).mean() - prior * loss(-score(xp, w)).mean()
        got = toxicity.risk(xp, xu, w, prior)
        assert np.allclose(got[:2], [confirmed(w), clean(w)], atol=1e-5)
        branches.add(got[1] >= 0)
        aim = (lambda w: confirmed(w) + clean(w)) if got[1] >= 0 else (lambda w: -clean(w))  # noqa: B023
        slope = [(aim(w + e) - aim(w - e)) / 2e-5 for e in np.eye(7) * 1e-5]
        assert np.allclose(got[2], slope, atol=1e-3)
    assert branches == {True, False}


def test_learning_from_few_windows_of_many_languages(spark):
    words = {f"l{k}": [f"{chr(97 + k)}{i}{chr(97 + k)}" for i in range(40)] for k in range(7)}
    rng = random.Random(2)
    langs = [f"l{i % 7}" for i in range(210)]
    docs = docs_of(spark, [" ".join(rng.choices(words[lang], k=30)) for lang in langs], langs)
    model = langid.learn(docs)
    assert model.languages == sorted(words) and model.lexicon
    got = langid.languages(docs, model).collect()
    assert all(r.lang_pred == langs[r.doc_id] for r in got)
    again = langid.learn(docs)
    assert (model.weights == again.weights).all()  # a task that runs again makes the same steps


def test_softmax_buffers_hold_one_batch_and_give_the_plain_softmax():
    rng = np.random.default_rng(3)
    weights, bias, rows, gold = rng.normal(0, 3, (50, 7)).astype(np.float32), rng.normal(0, 1, 7).astype(np.float32), rng.integers(0, 50, (23, 4)), rng.integers(0, 7, 23)
    z = weights[rows].astype(np.float64).sum(1) + bias
    plain = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    shares = lm.Shares(weights, bias, 10)
    for a in range(0, 23, 10):
        np.testing.assert_allclose(shares.of(rows[a : a + 10]), plain[a : a + 10], rtol=1e-4, atol=1e-7)
    assert shares.sums.shape == shares.row.shape == (10, 7)
    np.testing.assert_allclose(lm.gold_logs(weights, bias, rows, gold, batch=10), np.log(plain[np.arange(23), gold]), rtol=1e-4, atol=1e-5)


def test_scores_come_from_codes_without_texts(spark):
    docs = spark.createDataFrame([(i, i % 5 == 1, None if not i else f"some words {i}") for i in range(40)], "doc_id long, held_out boolean, text string").coalesce(1)
    model, _, codes = lm._learned(docs, 5, None, 1)
    found = codes.orderBy("doc_id").toArrow().combine_chunks().to_batches()
    assert [w for w in found[0].column("rest").to_pylist() if w][:1] and len(found[0]) == 40
    scored = pa.Table.from_batches(lm._scores(model)(iter([found[0].drop_columns(["rest"])])))
    want = {r.doc_id: (r.held_out, r.n_tokens) for r in lm._learned(docs, 5, None, 1)[2].selectExpr("doc_id", "held_out", "octet_length(marks) div 4 as n_tokens").collect()}
    assert {r["doc_id"]: (r["held_out"], r["n_tokens"]) for r in scored.to_pylist()} == want
    assert want[0] == (False, 1) and want[6] == (True, 4)
