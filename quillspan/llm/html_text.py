"""HTML extraction by the maximum-scoring subsequence of tokens.

A page is a sequence of tokens: words score positive and tags negative, and the content region is the contiguous run with
the largest sum, found by one linear scan over all tokens, those of menus and adverts too. The weights are log-odds learned
from labelled pages: those that mark their article (``<article>``, else ``<main>`` or ``role=main``) say which tokens are
inside. A tag is known by its element and class; the marks of the article itself are labels and no tokens, and pages
without them are scanned alike.

The region's bounds are the scan's, but for blocks of links: these score negative wherever they stand, so those that follow
or precede the region in its own container belong to it. Inside the bounds, elements that are boilerplate by name or class
(an advert or a form amid the article) are left out; a class inside a sentence cuts nothing out of it, adverts excepted.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the weights are learned from, at most about.
LABELLED = 4000

# Fixed values of HTML: elements without content, with content that is no text, that break no line, and of boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label picture source ruby rb rt rp math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace mtable mtr mtd semantics annotation button".split())
SKIPPED = frozenset("head nav header footer aside form button select option template dialog menu svg canvas object audio video map datalist fieldset".split()) | RAW
ARTICLE = frozenset(["article", "main"])
#: Words of a class, id or role that mark boilerplate.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer"
    " sidebar aside rail widget widgets comment comments commentlist disqus replies reply respond cookie cookies consent gdpr notice notices notification alert popup modal overlay"
    " newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager toolbar search form complementary contentinfo".split()
)
#: Those of them that mark a paragraph only if it is made of links, and those that mark a part of a sentence.
WEAK = frozenset("share sharing social related recommended recommendations search form toolbar rail replies reply respond comment comments login signup menu navigation nav banner header footer".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())
#: Elements that only arrange their parent's content.
ARRANGING = frozenset("ul ol li dl dt dd table tbody thead tfoot tr td th blockquote figure figcaption pre".split())
#: Beginnings of such words that run on, as in cookiebar.
STEMS = ("cookie", "advert", "sponsor", "comment", "sidebar", "newsletter", "breadcrumb", "navbar", "popup")
#: Words that may stand beside these in a name without changing what it means.
NEUTRAL = frozenset("site page main primary secondary global top bottom left right container wrapper wrap box block inner outer area section list item items bar unit slot links posts articles stories text content".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)


@dataclass(slots=True)
class Block:
    """Text between two breaks of a line, with what stands before it."""

    text: str
    words: int
    linked: int  # of the words, those inside links
    tags: list[str]  # opened since the last block
    skipped: bool  # inside an element that is boilerplate by name or class
    article: bool
    main: bool
    container: int = 0  # the innermost element around it that does more than arrange; 0: the body


def _names(attributes: str) -> tuple[list[tuple[str, list[list[str]]]], bool]:
    """The class, id and role of an element, words of each name, and whether the element is hidden."""
    found, hidden = [], False
    for kind, value in ATTRIBUTE.findall(attributes):
        kind, value = kind.lower(), value.strip("\"'")
        if kind in ("class", "id", "role"):
            names = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split()
            found.append((kind, [[w for w in re.split(r"[^a-z]+", n) if w] for n in names]))
        elif kind == "hidden":
            hidden = hidden or value.lower() != "false"
        elif kind == "aria-hidden":
            hidden = hidden or value.lower() == "true"
        elif kind == "style":
            hidden = hidden or bool(NOT_SHOWN.search(value))
    return found, hidden


def _listed(word: str) -> bool:
    return word in BOILERPLATE or word.startswith(STEMS)


def _skips(name: str, names: list[tuple[str, list[list[str]]]], in_article: bool) -> bool:
    """Is the element boilerplate by its own name, or by a name that says nothing else? ``post-header`` says more."""
    if name in SKIPPED:
        return not (name == "header" and in_article)
    return name not in ("body", "html") and any(any(map(_listed, words)) for words in _telling(name, names))


def _telling(name: str, names: list[tuple[str, list[list[str]]]]) -> list[list[str]]:
    """The names of an element that are made of listed words, and of words that change nothing."""
    kinds = [own for kind, own in names if name not in HEADINGS and (name not in ARTICLE or kind == "role")]
    return [words for own in kinds for words in own if words and any(map(_listed, words)) and all(_listed(w) or w in NEUTRAL for w in words)]


def _token(name: str, names: list[tuple[str, list[list[str]]]]) -> str:
    """A tag as the weights know it: its element and the words of its class, id and role."""
    words = sorted({w for _, own in names for n in own for w in n})
    return f"{name}.{'-'.join(words)}" if words else name


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, boilerplate ones too, in one pass."""
    found: list[Block] = []
    # Open elements that matter: name, and what held before: skipped, dropped, article, main, container.
    stack: list[tuple[str, tuple[bool, bool, bool, bool, int]]] = []
    opened: Counter = Counter()  # of each name in the stack, so that an end tag without a start costs nothing
    parts: list[str] = []
    tags: list[str] = []
    skipped = dropped = article = main = False  # dropped: inside an inline advert or something hidden
    paragraph = weak = inside = False  # in a <p> that is boilerplate; in one that is if it is made of links; in any
    container = containers = link = words = linked = 0

    def close() -> None:
        nonlocal parts, tags, words, linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            found.append(Block(text, words or 1, linked, tags, skipped or paragraph or (weak and 2 * linked >= words), article, main, container))
            tags = []
        parts, words, linked = [], 0, 0

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        m = TOKEN.match(page, start) if start >= 0 else None
        while m is None and start >= 0:  # a lone "<" is text
            start = page.find("<", start + 1)
            m = TOKEN.match(page, start) if start >= 0 else None
        end = start if start >= 0 else n
        if end > at and not dropped:
            text = page[at:end]
            parts.append(text)
            count = len(text.split())
            words += count
            linked += count if link else 0
        if m is None:
            break
        at = m.end()
        name = m[1]
        if name is None:
            if m[0].startswith("<![CDATA[") and not dropped:
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, attributes = name.lower(), m[2]
        closing = page[m.start() + 1] == "/"
        names, hidden = _names(attributes) if attributes and not closing else ([], False)
        if name in INLINE:
            if name == "a":
                link = max(0, link + (-1 if closing else 1))
            if closing:
                if stack and stack[-1][0] == name:
                    opened[name] -= 1
                    skipped, dropped, article, main, container = stack.pop()[1]
            else:
                advert = any(w in ADVERTS for own in _telling(name, names) for w in own)
                if name not in VOID and (dropped or hidden or advert or (name == "button" and not inside)):
                    stack.append((name, (skipped, dropped, article, main, container)))  # inner ones too, so that ends pair up
                    opened[name] += 1
                    dropped = True
                tags.append(_token(name, names))
            continue
        close()
        paragraph = weak = inside = False
        link = 0 if name != "br" else link
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(page, at)
            at = n if end is None else page.find(">", end.start()) + 1 or n
            continue
        if closing:
            if opened[name]:
                while True:  # ends what was left open inside, too
                    last, before = stack.pop()
                    opened[last] -= 1
                    if last == name:
                        skipped, dropped, article, main, container = before
                        break
            continue
        is_main = name == "main" or any(kind == "role" and ["main"] in own for kind, own in names)
        if name not in ARTICLE and not is_main:
            tags.append(_token(name, names))
        if name in VOID:
            continue
        if name == "p":  # it ends with the next block
            inside = True
            listed = {w for own in _telling(name, names) for w in own if _listed(w)}
            weak = bool(listed) and listed <= WEAK
            paragraph = hidden or bool(listed - WEAK)
            continue
        stack.append((name, (skipped, dropped, article, main, container)))
        opened[name] += 1
        article = article or name == "article"
        main = main or is_main
        skipped = skipped or hidden or _skips(name, names, article)
        if name in ("body", "html"):
            container = 0
        elif name not in ARRANGING and name not in HEADINGS:
            containers += 1
            container = containers
    close()
    return found


@dataclass
class Weights:
    """Scores of a word, a word inside a link, and of tags by element and class.

    Words of elements that are boilerplate by name or class count nothing. Tags that no labelled page has count ``other``,
    or ``listed`` where a word of their class is one of boilerplate.
    """

    word: float = 1.0
    linked: float = -0.5
    tags: dict[str, float] | None = None
    other: float = -0.5
    listed: float = -1.5

    def tag(self, token: str) -> float:
        found = (self.tags or {}).get(token)
        if found is not None:
            return found
        name, _, words = token.partition(".")
        return self.listed if name in SKIPPED or (name not in HEADINGS and any(map(_listed, words.split("-")))) else self.other

    def score(self, block: Block) -> float:
        plain = 0.0 if block.skipped else (block.words - block.linked) * self.word
        return plain + block.linked * self.linked + sum(map(self.tag, block.tags))


def tally(pages: list[str]) -> Counter:
    """How often each kind of token is inside and outside the marked article, over the pages that mark one."""
    counts: Counter = Counter()
    for page in pages:
        every = blocks(page)
        by_article = any(b.article for b in every)
        if by_article or any(b.main for b in every):
            for b in every:
                inside = (b.article if by_article else b.main) and not b.skipped
                counts["word", inside] += b.words - b.linked
                counts["linked", inside] += b.linked
                counts.update(("tag:" + t, inside) for t in b.tags)
    return counts


def weigh(counts: Counter) -> Weights:
    """Weights from counts of tokens: log-odds of being inside, within bounds, so that no tag outweighs a sentence."""
    if not counts:
        return Weights()

    def odds(kind: str) -> float:
        return math.log((counts[kind, True] + 1) / (counts[kind, False] + 1))

    tags = {k[4:]: max(-2.0, min(-0.1, odds(k))) for k, _ in counts if k.startswith("tag:")}
    return Weights(min(1.0, max(0.1, odds("word"))), max(-0.5, min(-0.1, odds("linked"))), tags)


def region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum, the first and longest of equal ones."""
    best, found, total, start = -math.inf, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0 or i == 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and start == found[0]):
            best, found = total, (start, i + 1)
    return found


def content(page: str | None, weights: Weights) -> list[Block]:
    """The blocks of the page's content region, boilerplate inside it too."""
    every = blocks(page or "")
    if not every:
        return []
    a, b = region([weights.score(x) for x in every])
    links = lambda x, edge: not x.skipped and 2 * x.linked >= x.words and x.container and x.container == edge.container
    while a and links(every[a - 1], every[a]):
        a -= 1
    while b < len(every) and links(every[b], every[b - 1]):
        b += 1
    return every[a:b]


def main_text(page: str | None, weights: Weights) -> str:
    """The content region's blocks without boilerplate elements, one a line."""
    return "\n".join(b.text for b in content(page, weights) if not b.skipped)


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = tally([p for p in batch.column("html").to_pylist() if p])
        yield pa.record_batch([pa.array([k for k, _ in found], pa.string()), pa.array([i for _, i in found], pa.bool_()), pa.array(list(found.values()), pa.int64())], names=["kind", "inside", "n"])


def learn(pages: DataFrame, labelled: int = LABELLED) -> Weights:
    """Weights from about ``labelled`` pages, chosen by the hash of their id; tokens are counted in the tasks."""
    n = pages.count()
    if not n:
        return Weights()
    drawn = pages.select("html").filter(F.pmod(F.xxhash64(F.col("page_id").cast("long")), F.lit(1_000_000)) < 1 + labelled * 1_000_000 // n)
    rows = drawn.mapInArrow(_tallies, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    return weigh(Counter({(r.kind, r.inside): r.n for r in rows}))


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    Character references are decoded, white space inside a block becomes one space, and blocks are joined by a line feed in
    page order. Null and empty pages, and pages without content, give an empty text. Repeated rows and nulls stay.
    """
    weights = weights or learn(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column("html").to_pylist()]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]  # a reference may name half a surrogate pair
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
