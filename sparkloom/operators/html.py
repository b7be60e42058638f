"""Page trees, their plain text, and titled sections of plain text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What is dropped whole, and what doesn't break a line.
DROPPED = frozenset(("nav", "footer", "script", "style", "aside", "header"))
INLINE = frozenset(("a", "span", "i", "b", "strong", "em", "u"))
#: Elements that a new one of the same kind ends, up to the container named after them.
ENDS = {"p": (), "li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    """An element (tag, attrs, children) of a page; text is a child of type str."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def walk(self):
        """All elements below, in page order."""
        for child in list(self.children):
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def find(self, test):
        return next((n for n in self.walk() if test(n)), None)

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def strings(self):
        for child in self.children:
            if isinstance(child, str):
                yield child
            else:
                yield from child.strings()

    def text(self, separator: str = "") -> str:
        return separator.join(s for s in (x.strip() for x in self.strings()) if s)

    def index(self) -> int:
        return next(i for i, c in enumerate(self.parent.children) if c is self)

    def remove(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.index()]
            self.parent = None

    def replace(self, *others: Node | str) -> None:
        at, parent = self.index(), self.parent
        for o in others:
            if isinstance(o, Node):
                o.parent = parent
        parent.children[at : at + 1] = others
        self.parent = None

    def unwrap(self) -> None:
        self.replace(*self.children)

    def attached(self) -> bool:
        n = self
        while n.parent is not None:
            n = n.parent
        return n.tag == "#page"


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = self.at = Node("#page")

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end("p", ())
        if tag in ENDS:
            self._end(tag, ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def _end(self, tag: str, up_to) -> bool:
        n = self.at
        while n.parent is not None and n.tag not in up_to:
            if n.tag == tag:
                self.at = n.parent
                return True
            if n.tag in BLOCKS and n.tag != "p" and not up_to:
                return False
            n = n.parent
        return False

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.page


def page_text(page: str | None) -> str:
    """Text lines of a page's main part, without navigation and scripts.

    The main part is <main>, else div#section-body, else <body>; without any the text is empty. Comments, null and
    empty pages have no text.
    """
    if not page:
        return ""
    root = parse(page)
    main = root.find(lambda n: n.tag == "main" and not _dropped(n)) or root.find(lambda n: n.tag == "div" and n.attrs.get("id") == "section-body" and not _dropped(n)) or root.find(lambda n: n.tag == "body")
    if main is None:
        return ""
    lines: list[list[str]] = [[]]

    def read(node: Node) -> None:
        for child in node.children:
            if isinstance(child, str):
                lines[-1].append(child)
            elif child.tag in INLINE:
                read(child)
            elif child.tag not in DROPPED:
                lines.append([])
                read(child)
                lines.append([])

    read(main)
    found = ("".join(x).strip() for x in lines)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x for x in found if x)).strip()


def _dropped(node: Node) -> bool:
    while node is not None:
        if node.tag in DROPPED:
            return True
        node = node.parent
    return False


def html_to_text(html: Column) -> Column:
    @F.arrow_udf("string")
    def _page_text(html: pa.Array) -> pa.Array:
        return pa.array([page_text(x) for x in html.to_pylist()], pa.string())

    return _page_text(html)


# The titles that begin a section.
TITLES = ("Description", "Frequency", "Causes", "Inheritance", "Symptoms", "Treatment")
_HEADINGS = {t: re.compile(rf"(?:^|\n\s*)(?:{t})(?:\s*\n|$)", re.IGNORECASE) for t in TITLES}


def titled_sections(text: str | None) -> list[tuple[str, str]]:
    """(title, content) of a text whose titles stand alone on a line, in any case; ("General", text) without titles.

    What stands before the first title, and sections without content, are left out. The white space around a title
    belongs to it, so of two equal titles on neighbouring lines the second is content. Null counts as empty.
    """
    text = text or ""
    heads = sorted((m.span(), t) for t, heading in _HEADINGS.items() for m in heading.finditer(text))
    if not heads:
        return [("General", text.strip())]
    ends = [*(span[0] for span, _ in heads[1:]), len(text)]
    found = ((title, text[span[1] : end].strip()) for (span, title), end in zip(heads, ends))
    return [x for x in found if x[1]]


def parse_sections(text: Column) -> Column:
    @F.arrow_udf("array<struct<pos:int,section:string,text:string>>")
    def _titled(text: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("section", pa.string()), ("text", pa.string())]))
        return pa.array([[{"pos": i, "section": s, "text": t} for i, (s, t) in enumerate(titled_sections(x))] for x in text.to_pylist()], kind)

    return _titled(text)


