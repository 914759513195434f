"""Main text of html pages by two-pass block rules.

The html is cut into blocks at block-level tags; comments, scripts, styles and
other unseen elements give none. Pass 1 labels each block from its length,
stop-word density and link density: many links are boilerplate (but in the article
a long block with stop words, of which some words are no link, is text), long
blocks with stop words are text, and the others stay ambiguous. On a page without
any text so far, the ambiguous blocks of a container count as one, so that short
paragraphs make a long block. Pass 2 gives each ambiguous block the label of the
nearest decided block of its own container (on a tie, text for a heading). Where
its container has none, it is text between two blocks of text; and where nothing
decides it, it is text inside the article only.

Where a block stands shifts the rules. Menus, headers, footers, asides and the
like, by tag or role, are boilerplate. So are elements whose names (id, class)
say sidebar, notice, advert, comments and so on, and forms; but a name is one
vote: where all prose of the page, or all its ``article`` and ``main`` elements,
stand inside such elements, those around the article, or around the most prose,
are taken for wrappers of the page.
Within an ``article`` or ``main`` element (where there is none, a division named
content, story or the like) long blocks need no stop words; blocks outside it are
boilerplate, unless the elements hold less than ``ARTICLE_SHARE`` of the page's
prose: then density decides everywhere.

Length is counted in words; in scripts without spaces two letters are a word.
Besides the known stop words, short words that a page repeats often count as
such, so that other languages have some.

Defined results: null and empty html give an empty text. One output row for each
input row; unclosed and stray tags are taken as browsers take them, roughly; no
text is cut or capped. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.arrow_text import tidy

# Element names, cue words and stop words.
UNSEEN = frozenset("head script style noscript template svg math iframe object embed applet canvas audio video map title textarea select option button datalist".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
CHROME = frozenset("nav header footer aside menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
CUES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices banner popup modal overlay comment comments reply replies disqus discussion respond responses feedback guestbook opinions share sharing social related recommended newsletter subscribe signup login pagination pager toolbar toc skip".split()
)
#: Parts of names that say the same wherever they stand (commentlist, topSidebar).
CUE_PARTS = ("comment", "cookie", "sidebar", "advert", "promo", "newsletter", "breadcrumb", "footer", "sponsor", "popup", "disqus", "navigation", "navbar", "subscri")
#: Words that hold such a part and say something else, and words beside a cue that turn its sense (has-sidebar, ad-free).
NO_CUES = frozenset("commentary commentaries commentator promoter promontory".split())
TURNS = frozenset("has have with no non not without hide free".split())
#: Names of elements that hold the text of a page without an article or main element.
CONTENT = frozenset("article content main story entry".split())
#: Function letters and words of languages that put no spaces between words.
UNSPACED_STOPS = re.compile("[のはをにがともたでだ的是在了不和有我他这]|ที่|ของ|และ|ใน|เป็น")
STOP_WORDS = frozenset(
    (
        "a an and are as at be by for from has have he in is it its not of on or she that the they this to was we were which will with you "
        "aber als am an auch auf aus bei das dem den der des die ein eine einer es für hat ich im in ist mit nicht oder sich sie sind so und von war wie wir zu zum "
        "au aux avec ce cette dans de des du elle en est et il la le les leur mais ne nous ou par pas plus pour que qui se son sur un une vous "
        "al como con de del el en es esta la las lo los más no o para pero por que se sin sobre su sus un una y ya"
    ).split()
)
MAX_LINKS = 0.5
LONG = 12
STOP_SHARE = 0.12
#: A page's own stop words: so short, and so large a share of its words, three at least.
OWN_LETTERS, OWN_SHARE = 4, 0.01
ARTICLE_SHARE = 1 / 3
#: Words of prose for which a name may be overruled where no article element stands below it.
WRAPPED = 60
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s*=\s*["']?(?:hidden)?["']?)?(?=\s|/|$)|display\s*:\s*none""", re.I)
ARTICLE = re.compile(r"<(?:article|main)\b", re.I)
WORDS = re.compile(r"\w+")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
TEXT, NOT, OPEN = 1, 0, None
#: What an element's tag and names say of it.
PLAIN, NAMED, BARRED = 0, 1, 2


def _cue(tag: str, attributes: str, in_article: bool) -> int:
    """BARRED for boilerplate by tag or role, NAMED by a name (or a form). The header of an article may hold its heading; names decide there."""
    if tag in CHROME and not (tag == "header" and in_article):
        return BARRED
    out = NAMED if tag == "form" else PLAIN
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() == "role":
            if ROLES.intersection(value.lower().strip("\"'").split()):
                return BARRED
        elif tag == "article":
            if {"comment", "comments", "reply", "related", "promo", "ad", "ads", "teaser"}.intersection(w.lower() for w in NAME_WORDS.findall(value)):
                out = NAMED
        elif tag not in ("body", "html", "main"):
            for one in value.strip("\"'").split():
                found = {w.lower() for w in NAME_WORDS.findall(one)}
                if in_article:
                    found.discard("header")
                if not TURNS & found and (CUES & found or any(part in w for w in found - NO_CUES for part in CUE_PARTS)):
                    out = NAMED
    return out


def _content(attributes: str) -> bool:
    """Whether an element's names say that it holds the text."""
    return any(name.lower() != "role" and CONTENT.intersection(w.lower() for w in NAME_WORDS.findall(value)) for name, value in ATTRIBUTE.findall(attributes))


def units(text: str) -> int:
    """Length in words; of scripts without spaces, two letters are a word."""
    n = len(text.split())
    return n if text.isascii() else max(n, n + len(UNSPACED.findall(text)) // 2 - 1)


class Block:
    """A run of text between block-level tags, in an element and a container of blocks."""

    __slots__ = ("container", "element", "heading", "linked", "parts")

    def __init__(self, element: int, heading: bool, container: int):
        self.parts, self.linked = [], 0
        self.element, self.heading, self.container = element, heading, container


class Page:
    """The blocks of a page in order, each with its text, and its elements: parent, cue, and whether they are the article."""

    def __init__(self, page: str):
        self.parent, self.cue, self.article = [0], [PLAIN], [False]
        self.blocks: list[tuple[Block, str]] = []
        for block in self._cut(page):
            text = " ".join(entities.unescape("".join(block.parts)).split())
            if text:
                self.blocks.append((block, text))

    def _element(self, parent: int, cue: int, article: bool) -> int:
        self.parent.append(parent)
        self.cue.append(cue)
        self.article.append(article)
        return len(self.parent) - 1

    def _cut(self, page: str) -> list[Block]:
        out: list[Block] = []
        stack: list[tuple[str, bool, int, bool, int]] = []  # tag, and before it: unseen, element, article, container
        opened: Counter[str] = Counter()
        unseen = article = heading = False
        element = container = links = made = 0
        named = ARTICLE.search(page) is None
        block = Block(element, heading, container)
        at, upto = 0, len(page)

        def add(text: str) -> None:
            if not unseen and text:
                block.parts.append(text)
                if links:
                    block.linked += units(text)

        def cut() -> Block:
            if block.parts:
                out.append(block)
            return Block(element, heading, container)

        def push(tag: str) -> None:
            stack.append((tag, unseen, element, article, container))
            opened[tag] += 1

        def pop() -> tuple[bool, int, bool, int]:
            tag, *before = stack.pop()
            opened[tag] -= 1
            return tuple(before)

        while at < upto:
            if (start := page.find("<", at)) < 0:
                add(page[at:])
                break
            add(page[at:start])
            m = TOKEN.match(page, start)
            if m is None:
                add("<")
                at = start + 1
                continue
            at = m.end()
            if m[2] is None:
                continue
            tag, closing, attributes = m[2].lower(), bool(m[1]), m[3]
            hidden = not closing and ("hidden" in attributes or "none" in attributes) and HIDDEN.search(attributes) is not None
            if tag in INLINE:
                links = max(0, links + (-1 if closing else 1)) if tag == "a" else links
                if tag != "span" or closing or not (hidden or _cue(tag, attributes, article)):
                    if tag == "span" and closing and stack and stack[-1][0] == "span":
                        unseen, element, article, container = pop()
                        block = cut()
                    continue
            if closing:
                if opened[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    unseen, element, article, container = pop()
                heading = heading and tag not in HEADINGS
                links = 0
                block = cut()
                continue
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "br", "hr") or tag in VOID:
                links = 0
                if stack and stack[-1][0] == tag:  # an open one of its kind ends here
                    unseen, element, article, container = pop()
                block = cut() if tag != "img" else block
                if tag not in VOID and ((cue := _cue(tag, attributes, article)) or hidden):
                    push(tag)
                    element = self._element(element, cue, False)
                    unseen = unseen or hidden
                    block = cut()
                continue
            if attributes.endswith("/"):
                continue
            if tag in ("article", "main") or tag == "body":
                links = 0
            if tag == "body" and unseen:  # the head was not closed
                stack, unseen = [], False
                opened.clear()
            push(tag)
            unseen = unseen or hidden or tag in UNSEEN
            made += 1
            container = made
            cue = _cue(tag, attributes, article)
            mine = tag in ("article", "main") or named and not cue and tag in ("div", "section") and _content(attributes)
            if cue or mine:
                element = self._element(element, cue, mine)
            article = article or mine
            heading = heading or tag in HEADINGS
            if tag in HEADINGS or tag in ("div", "blockquote", "pre", "tbody", "figure", "figcaption", "section"):
                container = stack[-1][4]
            block = cut()
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                unseen, element, article, container = pop()
                heading = heading and tag not in HEADINGS
                at = end.end() if end else upto
                block = cut()
        cut()
        return out


def measures(texts_: list[str]) -> list[tuple[int, float]]:
    """Length and stop-word density of each block of a page."""
    words = [WORDS.findall(text.lower()) for text in texts_]
    counts = Counter(w for ws in words for w in ws if len(w) <= OWN_LETTERS and not w.isdecimal())
    least = max(3, OWN_SHARE * sum(map(len, words)))
    stop = STOP_WORDS | {w for w, n in counts.items() if n >= least}
    out = []
    for text, ws in zip(texts_, words, strict=True):
        stops, n = sum(w in stop for w in ws), max(1, len(ws))
        if not text.isascii() and (letters := len(UNSPACED.findall(text))):
            stops, n = stops + len(UNSPACED_STOPS.findall(text)), n + letters // 2
        out.append((units(text), stops / n))
    return out


def two_passes(n: list[int], stops: list[float], linked: list[int], inside: list[bool], barred: list[bool], container: list[int], heading: list[bool]) -> list[int]:
    """The label of each block. ``inside`` the article, long blocks need no stop words; ``barred`` blocks are boilerplate and decide no others."""
    out = []
    for i in range(len(n)):
        prose = n[i] >= LONG and stops[i] >= STOP_SHARE
        if barred[i] or linked[i] > MAX_LINKS * n[i] and not (inside[i] and prose and linked[i] < n[i]):
            out.append(NOT)
        else:
            out.append(TEXT if prose or inside[i] and n[i] >= LONG else OPEN)
    if TEXT not in out:
        pooled: Counter[int] = Counter()
        stopped: Counter[int] = Counter()
        for i, x in enumerate(out):
            if x is OPEN:
                pooled[container[i]] += n[i]
                stopped[container[i]] += n[i] * stops[i]
        out = [TEXT if x is OPEN and pooled[c] >= LONG and stopped[c] >= STOP_SHARE * pooled[c] else x for x, c in zip(out, container, strict=True)]
    # The nearest decided block before and after each one: of its container, and of any.
    near = []
    for order in (range(len(n)), range(len(n) - 1, -1, -1)):
        own, any_, found = {}, None, {}
        for i in order:
            found[i] = own.get(container[i]), any_
            if out[i] is not OPEN and not barred[i]:
                own[container[i]] = any_ = i
        near.append(found)
    said = {}
    for i in [i for i, x in enumerate(out) if x is OPEN]:
        (one, before), (two, after) = near[0][i], near[1][i]
        both = [(abs(j - i), out[j]) for j in (one, two) if j is not None]
        labels = {x for d, x in both if d == min(both)[0]}
        if len(labels) == 1:
            said[i] = labels.pop()
        elif labels:
            said[i] = TEXT if inside[i] or heading[i] else NOT
        else:
            between = before is not None and after is not None and out[before] == out[after] == TEXT
            said[i] = TEXT if inside[i] or between else NOT
    return [said.get(i, x) for i, x in enumerate(out)]


def _wrappers(page: Page, sizes: list[int], prose: list[bool], article: list[bool]) -> set[int]:
    """The named elements that are taken for wrappers of the page: those around the article, or else around the most prose, where it stands in the fewest of them.

    ``article``: blocks in an article element that are long and no list of links.
    """
    hard, deep, top, other = [False], [0], [0], [False]
    for k in range(1, len(page.cue)):
        up, named = page.parent[k], page.cue[k] == NAMED
        hard.append(hard[up] or page.cue[k] == BARRED)
        deep.append(deep[up] + named)
        top.append(top[up] or (k if named else 0))
        other.append(other[up] or named and page.article[k])  # an article's own name is no wrapper's
    of = [b.element for b, _ in page.blocks]
    inside = [i for i, k in enumerate(of) if article[i] and not hard[k] and not other[k]]
    if not any(article):
        words: Counter[int] = Counter()
        for i, k in enumerate(of):
            if prose[i] and not hard[k]:
                words[top[k]] += sizes[i]
        most = max(words.values(), default=0)
        inside = [i for i, k in enumerate(of) if prose[i] and not hard[k] and words[top[k]] >= max(WRAPPED, most / 2)]
    least = min((deep[of[i]] for i in inside), default=0)
    out: set[int] = set()
    seen = {0}
    for i in inside:
        k = of[i]
        if deep[k] == least:
            while k not in seen:
                seen.add(k)
                if page.cue[k] == NAMED:
                    out.add(k)
                k = page.parent[k]
    return out


def labels(page: Page) -> list[int]:
    """The label of each block of a page."""
    found = page.blocks
    measured = measures([text for _, text in found])
    sizes, stops = [n for n, _ in measured], [s for _, s in measured]
    linked, of = [b.linked for b, _ in found], [b.element for b, _ in found]
    long = [n >= LONG and k <= MAX_LINKS * n for n, k in zip(sizes, linked, strict=True)]
    prose = [x and s >= STOP_SHARE for x, s in zip(long, stops, strict=True)]
    inside = [False]
    for k in range(1, len(page.cue)):
        inside.append(inside[page.parent[k]] or page.article[k])

    def barred(cue: list[int]) -> list[bool]:
        out = [False]
        for k in range(1, len(cue)):
            out.append(out[page.parent[k]] or cue[k] != PLAIN)
        return out

    def words(test: list[bool]) -> int:
        return sum(sizes[i] for i, k in enumerate(of) if prose[i] and test[k])

    # Names hold as long as an article, or else some prose, is left outside them.
    bar = barred(page.cue)
    article = [x and inside[k] for x, k in zip(long, of, strict=True)]
    left = words([not x for x in bar])
    if not any(a and not x for a, x in zip(page.article, bar, strict=True)) and left < (WRAPPED if any(article) else 1):
        around = _wrappers(page, sizes, prose, article)
        bar = barred([PLAIN if k in around else c for k, c in enumerate(page.cue)])
    whole = any(inside[k] and not bar[k] for k in of) and words([a and not x for a, x in zip(inside, bar, strict=True)]) >= ARTICLE_SHARE * words([not x for x in bar])
    favoured = [whole and inside[k] for k in of]
    out = [bar[k] or whole and not inside[k] for k in of]
    return two_passes(sizes, stops, linked, favoured, out, [b.container for b, _ in found], [b.heading for b, _ in found])


def main_text(page: str | None) -> str:
    """The text blocks of a page, joined by a space."""
    whole = Page(page or "")
    return " ".join(text for (_, text), label in zip(whole.blocks, labels(whole), strict=True) if label == TEXT)


@tidy
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(x.as_py()) for x in part.column(2)], pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, f"page_id {dict(pages.dtypes)[id_col]}, url string, text string")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
