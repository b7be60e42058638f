"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page becomes a flat list of text blocks. Each is described by its word count and link density, those of the blocks
before and after it, its kind (heading, paragraph, list item, other), and its containers: the share of the article
containers' words in its own one, and the shares of the page's words in the nearest containers that stand for
boilerplate by their tag or by a word of their class or id. No container decides alone: one that holds nearly the whole
page, or the article, is a wrapper. A decision tree, trained on a small labelled table of page sketches, keeps or drops
each block.

Null or empty html, or a page without kept blocks, gives an empty text. Pages and their tags' attributes are read whole,
however long. Repeated rows give repeated results; an empty table gives an empty result. Other columns are carried along
untouched; one that is named as the new column is replaced.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Raw-text elements end at their own end tag only; what they hold is never text of the page.
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(script|style|textarea|title|iframe|xmp|noembed|noframes)\b(?:"[^"]*"|'[^']*'|[^>"'])*+>(?:.*?</\1\b[^>]*+>|.*\Z)
    |<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>
    |<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>
    |<[!?][^>]*+>""",
    re.S | re.I | re.X,
)
#: One attribute after the other, so that what stands within a value isn't taken for an attribute.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Attributes up to this length are remembered with their traits; longer ones are read anew, so the memory stays bounded.
REMEMBERED_CHARS = 2000

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input label picture source track "
    "math mi mn mo ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form menu button select option datalist dialog noscript template svg canvas head audio video applet map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class or id attributes (or roles) that mark what is not the article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promos banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar masthead topbar "
    "sidebar sidebars aside widget widgets rail related recommended recommendations trending popular teaser teasers "
    "footer copyright colophon legal disclaimer cookie cookies consent gdpr notice notices alert popup modal overlay dialog "
    "comment comments commentlist disqus respond reply replies discussion "
    "share sharing social newsletter subscribe subscription signup login search "
    "contentinfo complementary skip skiplink hidden".split()
)
_NEGATED = frozenset("no not without has with".split())
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def _is_hint(value: str) -> bool:
    before = ""
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        for w in words:
            if w in HINTS and before not in _NEGATED:
                return True
            before = w
        before = ""
    return False


#: What an element stands for: the article, boilerplate by its tag or state, boilerplate by a word, a header.
MAIN, STRONG, WEAK, HEADER = 1, 2, 4, 8


def _traits(tag: str, attrs: str) -> int:
    """What an element stands for; its attributes are read whole."""
    return (_remembered_traits if len(attrs) <= REMEMBERED_CHARS else _read_traits)(tag, attrs)


def _read_traits(tag: str, attrs: str) -> int:
    found = MAIN if tag in ("article", "main") else STRONG if tag in DROPPED else HEADER if tag == "header" else 0
    if attrs:
        for name, x, y, z in _ATTR.findall(attrs):
            name, value = name.lower(), x or y or z
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                found |= STRONG
            elif name == "role" and value.lower() == "main" or name == "itemprop" and value.lower() == "articlebody":
                found |= MAIN
            elif name in ("class", "id", "role") and tag not in ("html", "body", "main") and (tag != "article" or "comment" in value.lower()) and _is_hint(value):
                found |= WEAK
    return found & ~MAIN if found & (STRONG | WEAK) else found


_remembered_traits = functools.lru_cache(maxsize=4096)(_read_traits)

OTHER, ITEM, PARAGRAPH, HEADING = range(4)
KINDS = {**dict.fromkeys("li dd dt td th caption figcaption".split(), ITEM), **dict.fromkeys("p pre blockquote".split(), PARAGRAPH), **dict.fromkeys(HEADINGS, HEADING)}


class Container:
    """An element that stands for something: its words, and those of article containers inside it."""

    __slots__ = ("traits", "words", "inner")

    def __init__(self, traits: int):
        self.traits, self.words, self.inner = traits, 0, 0


class Block:
    __slots__ = ("text", "words", "links", "kind", "main", "strong", "weak", "header")

    def __init__(self, text, words, links, kind):
        self.text, self.words, self.links, self.kind = text, words, links, kind
        self.main: Container | None = None
        self.strong: Container | None = None
        self.weak: Container | None = None
        self.header = False

    @property
    def density(self) -> float:
        return self.links / self.words if self.words else 0.0


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, each with its white space collapsed."""
    found: list[Block] = []
    stack: list[tuple[str, Container | None]] = []
    parts: list[str] = []
    words = links = anchors = 0

    def close() -> None:
        nonlocal words, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                block = Block(text, max(words, 1), min(links, max(words, 1)), OTHER)
                for tag, holder in reversed(stack):
                    if block.kind == OTHER:
                        block.kind = KINDS.get(tag, OTHER)
                    if holder is None:
                        continue
                    holder.words += block.words
                    if block.main is not None:
                        holder.inner += block.words
                    elif holder.traits & MAIN:
                        block.main = holder
                    if holder.traits & STRONG and block.strong is None:
                        block.strong = holder
                    if holder.traits & WEAK and block.weak is None:
                        block.weak = holder
                    block.header |= bool(holder.traits & HEADER)
                found.append(block)
            parts.clear()
        words = links = 0

    def add(raw: str) -> None:
        nonlocal words, links
        if raw:
            piece = entities.unescape(raw) if "&" in raw else raw
            parts.append(piece)
            n = len(piece.split())
            words += n
            if anchors:
                links += n

    def pop_to(i: int) -> None:
        nonlocal anchors
        del stack[i:]
        anchors = sum(tag == "a" for tag, _ in stack)

    at = 0
    for m in _MARKUP.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        tag = name.lower()
        if m[2] or m[5]:
            if tag not in INLINE:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            close()
            if tag not in VOID:
                # A new block ends an open paragraph; list items and cells end their siblings.
                ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or stack[i][0] in ends:
                        pop_to(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
        elif tag == "a":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "a":
                    pop_to(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        attrs = (m[4] if m[3] else m[7]) or ""
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "canvas", "template", "math"):
            continue
        traits = _traits(tag, attrs)
        stack.append((tag, Container(traits) if traits else None))
        anchors += tag == "a"
    add(page[at:])
    close()
    return found


#: A share that no container has: a block without one.
NONE = 2.0


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """Per block: words, link density; the same of the blocks before and after; kind; words of its article container as a
    share of the largest one's (0 without); the share of the page's words in its nearest container marked by tag, and
    whether that holds most of the articles' words; the same for one marked by a word; in a header; page has an article."""
    total = sum(b.words for b in found)
    mains = {id(b.main): b.main.words for b in found if b.main is not None}
    largest, inside = max(mains.values(), default=0), sum(b.words for b in found if b.main is not None)
    shape = [(0.0, 0.0), *((float(min(b.words, 400)), b.density) for b in found), (0.0, 0.0)]

    def mark(holder: Container | None) -> tuple[float, float]:
        return (NONE, 0.0) if holder is None else (holder.words / total, float(2 * holder.inner >= inside > 0))

    return [(*shape[i + 1], *shape[i], *shape[i + 2], float(b.kind), b.main.words / largest if b.main is not None else 0.0, *mark(b.strong), *mark(b.weak), float(b.header), float(largest > 0)) for i, b in enumerate(found)]


#: The labelled table: sketches of pages. k60 stands for a block of 60 words to keep, d5 for one of 5 words to drop.
SKETCHES = (
    # a marked article
    "<nav><ul><li><a>d1</a><li><a>d2</a><li><a>d1</a></ul></nav><div class=ad>d8</div><article><h1>k12</h1><p>k60</p><p>k25</p><p>k90</p></article><footer>d12</footer>",
    "<nav><li><a>d1</a><li><a>d1</a></nav><article><h1>k2</h1><p>k3</p><p>k1</p></article><footer>d9</footer>",
    "<header><a>d2</a><p>d6</p></header><nav><a>d2</a></nav><article><header><h1>k8</h1><p>d4</p></header><p>k70</p><h2>k3</h2><p>k40</p><ul><li>k4<li>k9</ul><p>k1</p></article><aside><h3>d2</h3><p>d30</p></aside><footer><p>d20</p></footer>",
    "<div class=cookie-notice><p>d14</p></div><main><h1>k6</h1><p>k120</p><p>k4</p><div class=share><a>d1</a><a>d1</a></div><p>k60</p></main><section id=comments><h3>d2</h3><p>d40</p><p>d15</p></section>",
    "<article><p>k300</p><div class=ad>d9</div><p>k40</p><form><p>d5</p></form><p>k3</p><aside><p>d25</p></aside><div class=related><h4>d2</h4><li><a>d6</a></div></article><div><p>d20</p></div>",
    "<article><h1>k5</h1><p><a>k3</a></p><p>k50</p><p><a>k6</a></p><p>k40</p></article><div><a>d4</a></div>",
    "<article><h1>k7</h1><p>k30 <a>k9</a></p><h2><a>k4</a></h2><p>k45</p><ul><li><a>k5</a><li>k8</ul><p>k20</p></article>",
    "<article><p>k80</p><ul><li><a>d4</a><li><a>d6</a><li><a>d3</a><li><a>d5</a></ul></article><footer><p>d40</p><p>d60</p></footer>",
    "<article><p>k80</p><p>k9</p><div><a>d3</a> <a>d4</a> <a>d2</a></div><div><a>d5</a></div></article>",
    "<div><p>d30</p></div><article><h1>k4</h1>k20<p>k15</p><div>k35</div><div>k3</div></article><div>d5</div>",
    "<div><p>d50</p></div><div role=main><p>k45</p></div>", "<div><p>d120</p><p>d60</p></div><article><p>k30</p></article>", "<p>d70</p><h2>d6</h2><article><h1>k4</h1><p>k200</p></article><div><p>d90</p></div>",
    "<h2>d5</h2><p>d30</p><main><p>k25</p><p>k60</p></main><h3>d4</h3><ul><li>d12<li>d9</ul><p>d200</p>",
    "<div class=promo><h2>d4</h2><p>d60</p></div><article><h1>k9</h1><p>k15</p></article><section id=comments><p>d80</p><p>d120</p><p>d30</p></section>",
    "<main><article><h1>k9</h1><p>k65</p></article><section id=comments><article class=comment><p>d50</p></article><article class=comment><p>d20</p></article></section></main><footer>d5</footer>",
    "<main><article><h1>k4</h1><p>k200</p></article><section class=comments><article><p>d20</p></article><article><p>d30</p></article></section><div class=sidebar><p>d30</p></div></main>",
    "<article><p>k20</p></article><article><h2>k4</h2><p>k25</p></article><article><p>k40</p></article><nav><a>d2</a></nav>",
    "<div hidden><p>d30</p></div><article><h1>k3</h1><p>k60</p><p hidden>d12</p><table><tr><td>k2<td>k3<tr><td>k1<td>k12</table></article>",
    "<header><a>d1</a></header><nav><a>d1</a></nav><main><article><header><h1>k3</h1><p>d3</p></header><p>k8</p><p>k1</p></article></main><footer>d2</footer>",
    "<header><h1>d4</h1><h2>d3</h2></header><article><header><h2>k12</h2><div>d5</div></header><p>k30</p><p>k6</p></article>",
    "<article><h1>k3</h1><p>k8</p><p>k1</p><div class=ad>d10</div><form><p>d1</p></form><aside>d1</aside><ul><li>k1<li>k1</ul></article><section id=comments><p>d12</p></section><footer>d2</footer>",
    "<article><h1>k5</h1><div class=promo><p>d25</p></div><p>k30</p><nav><a>d2</a><p>d8</p></nav><p>k20</p><div class=newsletter><p>d15</p></div></article>",
    "<div class=notice><p>d12</p></div><main><article><header><h1>k1</h1><p>d9</p><p>d2</p></header><p>k5</p></article><div class=comments><p>d14</p></div></main>",
    # marks on what wraps the article
    "<div class='layout sidebar-right'><nav><a>d2</a><a>d3</a></nav><article><h1>k6</h1><p>k60</p><p>k5</p></article><div class=sidebar><p>d20</p></div></div><footer>d9</footer>",
    "<div class='single comments-open'><article><h1>k6</h1><p>k90</p></article><div id=comments><p>d40</p><p>d30</p></div></div>",
    "<div class=legal-article><article><h1>k3</h1><p>k40</p><p>k30</p></article></div>",
    "<form><nav><a>d1</a></nav><div class=banner-page><article><h1>k6</h1><p>k60</p></article></div><footer>d10</footer></form>",
    "<div class=legal-article><h1>k4</h1><p>k60</p><p>k45</p></div><footer>d8</footer>",
    "<form><h1>k4</h1><p>k50</p><p>k35</p><p>k40</p></form><footer>d8</footer>",
    "<div class=search-layout><div class=nav><a>d2</a> <a>d2</a></div><h1>k8</h1><p>k70</p><p>k90</p><p>k6</p></div>",
    # no marked article
    "<div><a>d2</a> <a>d3</a></div><div><h2>k3</h2><p>k14</p><p>k14</p></div><div><a>d1</a></div>",
    "<ul><li><a>d1</a><li><a>d2</a><li><a>d1</a></ul><div>d8</div><div><h1>k12</h1><p>k40</p><p>k25</p><p>k70</p></div><div>d12</div>",
    "<ul><li><a>d1</a><li><a>d1</a></ul><div>d10</div><h1>k9</h1><p>k6</p><p>k30</p><p>k9</p><p>k50</p><div>d9</div>",
    "<ul><li><a>d2</a><li><a>d1</a></ul><div>d6</div><h1>k13</h1><p>k25</p><div>d15</div>",
    "<ul><li><a>d1</a><li><a>d1</a></ul><div>d16</div><h1>k7</h1><p>k90</p><p>k150</p><div>d20</div>",
    "<header><h1>d3</h1></header><div class=menu><a>d2</a></div><div><h1>k7</h1><p>k60</p><p>k3</p><p>k80</p></div><div class=sidebar><h3>d2</h3><p>d40</p></div><footer><p>d25</p></footer>",
    "<div><p>k45</p></div><div class=sidebar><p>d51</p></div>",
    "<div><h1>k5</h1><p>k45</p><p>k80</p></div><div id=comments><p>d60</p><p>d90</p><p>d30</p></div>",
    "<div>k60</div><div>k120</div><div><a>d3</a></div><div>d4</div>",
    "<h1>k6</h1>k35<br><p>k50</p><ul><li>k8<li>k14<li>k6</ul><p>k22</p><div>d3</div>",
    "<p>k16</p>", "<p>k30</p><p>k300</p>", "<div>k40</div>", "<h1>k3</h1><p>k12</p>",
    "<nav><a>d1</a></nav>", "<div><a>d3</a></div><div><a>d30</a></div>", "<p><a>d4</a> <a>d3</a></p><div>d3</div><div><a>d2</a></div>", "<div>d2</div><div><a>d5</a></div><div>d4</div>",
    "<nav><p>d60</p></nav><footer><p>d90</p></footer>", "<div class=cookies><p>d30</p></div><aside><p>d50</p></aside>",
)
#: Each sketch counts as it is and so many times with its blocks' words changed by factors up to this one.
VARIANTS = 12
FACTOR = 2.2


def labelled_rows(sketches=SKETCHES, variants: int = VARIANTS) -> list[tuple[float, ...]]:
    """Features and label of every block of the sketches."""
    rng = random.Random(1)
    rows = []
    for sketch in sketches:
        for k in range(variants + 1):
            size = lambda n: max(1, round(n * (FACTOR ** rng.uniform(-1, 1) if k else 1)))  # noqa: B023, E731
            page = re.sub(r"\b([kd])(\d+)\b", lambda m: " ".join([m[1]] * size(int(m[2]))), sketch)
            found = blocks(page)
            rows += [(*x, int(b.text[0] == "k")) for b, x in zip(found, features(found))]
    return rows


def train_tree(rows, least: int = 1):
    """A Gini tree over rows (features..., label): nested (feature, threshold, left, right), leaves are 0 or 1."""
    labels = [r[-1] for r in rows]
    ones = sum(labels)
    if ones in (0, len(rows)):
        return int(ones > 0)
    best = None
    for f in range(len(rows[0]) - 1):
        ordered = sorted(rows, key=lambda r: r[f])
        left = 0
        for i in range(1, len(ordered)):
            left += ordered[i - 1][-1]
            if ordered[i][f] == ordered[i - 1][f] or i < least or len(ordered) - i < least:
                continue
            right, n = ones - left, len(ordered)
            impurity = 2 * left * (i - left) / i + 2 * right * (n - i - right) / (n - i)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, (ordered[i][f] + ordered[i - 1][f]) / 2)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, cut = best
    return f, cut, train_tree([r for r in rows if r[f] <= cut], least), train_tree([r for r in rows if r[f] > cut], least)


@functools.lru_cache(maxsize=1)
def default_tree():
    return train_tree(labelled_rows())


def classify(tree, x) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if x[f] <= cut else high
    return tree


def main_text(page: str | None, tree=None) -> str:
    if not page:
        return ""
    tree = default_tree() if tree is None else tree
    found = blocks(page)
    return "\n\n".join(b.text for b, x in zip(found, features(found)) if classify(tree, x))


def extractor(labelled=None):
    """An Arrow UDF from html to main text, its tree trained on the given labelled rows, or on those of the sketches."""
    tree = default_tree() if labelled is None else train_tree(labelled)

    @F.arrow_udf("string")
    def main_text_of(html: pa.Array) -> pa.Array:
        return pa.array([main_text(page, tree) for page in html.to_pylist()], pa.string())

    return main_text_of


def extract_main_text(pages: DataFrame, html: str | Column = "html", out: str = "text") -> DataFrame:
    """Add the main text of each page as column `out`; every other column stays."""
    return pages.withColumn(out, extractor()(F.col(html) if isinstance(html, str) else html))


def op1(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
