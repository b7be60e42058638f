"""Titled sections of health pages, by rules for each site.

A page goes through four steps: site-specific edits of its tree, blocks (headings, paragraphs, list items) of its
main content, a fold of the blocks into titled sections, and rules over the sections. The rules are tables; the
code that applies them knows no site. Main content is the densest container, chosen by own measures.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.operators.html import Node, parse

HEADING_MARK = "\x00heading:"
DEFAULT_TITLE = "[DESCRIPTION]"
WHOLE_TITLE = "[CONTENT]"
SHORT_TOPIC, MERGED_TOPIC = 10, 40


@dataclass(frozen=True)
class Site:
    """Rules of one site, applied in the order of the fields."""

    stop: tuple[str, ...] = ()  # a topic that holds one ends the page
    skip: tuple[str, ...] = ()  # topics that hold one are left out
    skip_equal: tuple[str, ...] = ()
    advert: tuple[str, ...] = ()  # of short topics, content that is left out
    advert_words: int = 0
    line_starts: tuple[str, ...] = ()
    line_holds: tuple[str, ...] = ()
    digit_lines: bool = False
    cut: tuple[str, ...] = ()  # strings to delete
    patterns: tuple[str, ...] = ()  # patterns to delete
    bullets_topic: str = ""  # topics whose short bullets lead the next
    lengths: bool = True  # short topics are dropped or merged


# The sites' rules.
GARD_NOISE = ("FIND A SPECIALIST", "RESEARCH", "ORGANIZATIONS", "LEARN MORE", "NEWS & EVENTS", "GARD ANSWERS", "REFERENCES")
SITES: tuple[tuple[str, Site], ...] = (
    ("ghr.nlm.nih.gov", Site()),
    (
        "cancer.gov",
        Site(
            stop=("[TO LEARN",),
            skip=("[ABOUT PDQ]", "[PURPOSE OF THIS SUMMARY]", "[REVIEWERS AND UPDATES]", "[CLINICAL TRIAL INFORMATION]", "[PERMISSION TO USE THIS SUMMARY]", "[DISCLAIMER]", "[CONTACT US]"),
            advert=("visit our", "available at", "is available from the nci"),
            advert_words=50,
            line_starts=("Learn more about", "Use our clinical trial search", "You can use the clinical trial search", "General information about clinical trials"),
            line_holds=("Information about clinical trials is available from the NCI",),
            patterns=(r"To learn more, visit Questions to Ask Your Doctor [Aa]bout Treatment\.?",),
        ),
    ),
    ("niddk.nih.gov", Site(stop=("CLINICAL TRAITS", "CLINICAL TRIALS", "REFERENCES"), skip_equal=("[]", "[TOP]"), digit_lines=True, cut=("[Top]", "[]", "[TOP]"))),
    ("ninds.nih.gov", Site(stop=("WHAT RESEARCH IS BEING DONE",), lengths=False)),
    ("rarediseases.info.nih.gov", Site(skip=(*GARD_NOISE, "SHOWING"), patterns=(r"\AListen\s*",))),
    ("nlm.nih.gov", Site(stop=("METHODOLOGY",), bullets_topic="INTERACTIONS")),
    (
        "cdc.gov",
        Site(
            skip=("CONTACT US", "HOW CAN I LEARN MORE ABOUT THIS"),
            patterns=(
                r"(?is)This symbol means you are leaving the CDC\.gov Web site.*?Notification and Disclaimer policy\.",
                r"(?is)File Formats: All viewers, players, and plug-ins used on this site can be downloaded from the file formats page.*?(?:etc\.\))",
                r"(?i)Content last reviewed.*",
                r"(?i)Page last reviewed.*",
                r"(?i)Content Source:.*",
            ),
        ),
    ),
)
ADDRESS = re.compile(r"National Institutes of Health, DHHS|55 Kenosia Avenue|1275 Mamaroneck Avenue|P\.?O\.? Box \d+|Bethesda, MD|Suite \d+|\d{5}-\d{4}", re.I)
GARD_BOILERPLATE = tuple(
    re.compile(p, re.S)
    for p in (
        r"(?i)skip to main content.*?rare diseases",
        r"Patient organizations can help.*?Questions about the information or resources it provides\.",
        r"Clinical studies are part of.*?terms/synonyms to improve results\.",
        r"Thank you for visiting the GARD website.*?Feedback Form",
        r"Thank you for visiting the new GARD website.*?GARD website\.",
        r"Thank you for visiting the GARD website.*?GARD website\.",
        r"We are currently developing a new version of GARD.*?(?:site|version\.)",
        r"Data from Orphanet and Human Phenotype Ontology.*?estimates, and more\.",
        r"Take steps toward getting a diagnosis.*?medical care\.",
        r"\d+\s+Symptoms",
        r"\d+\s+Organizations",
        r"ClinicalTrials.gov, an affiliate of NIH, provides current information.*?Except:\s*Federal Holidays\)",
        r"GARDGenetic and Rare Diseases.*?Eastern Time",
    )
)
GARD_LINES = frozenset(("Title", "See More", "Back to top", "A-", "Close", "Suggest an update", "Read More", "Read Less"))
GARD_SIDE = ("sidebar", "menu", "share", "social", "breadcrumb", "nav", "print", "disease-title", "location")


def site_rules(domain: str) -> Site:
    return next((rules for name, rules in SITES if name in domain), Site())


# --- the page's tree ---------------------------------------------------------------------------------------------


def lists_to_paragraphs(root: Node) -> None:
    """Each item of a list becomes a paragraph that begins with a dash."""
    for lst in root.all("ul", "ol"):
        if not lst.attached():
            continue
        made = []
        for li in lst.children:
            if isinstance(li, Node) and li.tag == "li":
                p = Node("p")
                p.children.append("- " + li.text(" "))
                made.append(p)
        lst.replace(*made)


def _mark_heading(node: Node, title: str) -> None:
    p = Node("p")
    p.children.append(HEADING_MARK + title)
    node.replace(p)


def undouble(title: str) -> str:
    half = len(title) // 2
    return title[:half] if len(title) > 4 and len(title) % 2 == 0 and title[:half] == title[half:] else title


@dataclass(frozen=True)
class Edit:
    """What is done with the nodes that all the given conditions pick, in page order."""

    action: str
    tags: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()  # words of the class
    looks: tuple[str, ...] = ()  # strings within class or id, whichever `within` names
    within: str = "class"
    id: str = ""
    says: str = ""  # a pattern in the text right below the node
    text: str = ""  # a pattern in all of its text
    title: str = "{}"  # of headings and sections, as a format of the text
    head: Edit | None = None  # of sections: where the title stands, and the body
    body: Edit | None = None

    def picks(self, n: Node) -> bool:
        return (
            (not self.tags or n.tag in self.tags)
            and (not self.id or n.attrs.get("id") == self.id)
            and (not self.classes or any(c in n.classes() for c in self.classes))
            and (not self.looks or any(x in n.attrs.get(self.within, "").lower() for x in self.looks))
            and (not self.says or any(isinstance(c, str) and re.search(self.says, c) for c in n.children))
            and (not self.text or re.search(self.text, n.text()) is not None)
        )

    def named(self, n: Node) -> str:
        title = undouble(n.text()) if self.title != "{}" else n.text()
        return self.title.format(title.upper() if self.title != "{}" else title)


#: A button that reads a text aloud, and the word that it leaves in front.
ALOUD = Edit("drop", tags=("a",), classes=("rsbtn_play",))
_ALOUD_WORD = re.compile(r"^Listen\s*")

NINDS_EDITS = (
    Edit("drop", says="You Are Here:"),
    Edit("drop", tags=("h2",), text=r"(?i)\A(?:\Z|table of contents)"),
    Edit("heading", tags=("h2",)),
    Edit("unwrap", tags=("div",), classes=("datadisplay",)),
    Edit("drop with rest", says=f"(?i){ADDRESS.pattern}"),
)
NIDDK_EDITS = (Edit("drop", tags=("a",), text=r"(?s)\A(?=.*Top).{0,5}\Z"),)
PANEL = Edit("section", tags=("div",), classes=("panel",), title="[{}]", head=Edit("", tags=("h2",), classes=("panel-title",)), body=Edit("", tags=("div",), classes=("panel-collapse",)))
#: Pages with panels: what stands about them goes, each panel is a section, and what is left is the description.
PANEL_EDITS = (
    Edit("drop", tags=("nav", "aside", "footer", "header")),
    Edit("drop", tags=("div",), looks=GARD_SIDE),
    Edit("drop", tags=("ol",), looks=("breadcrumb",)),
    Edit("drop", tags=("div",), looks=GARD_SIDE[:4], within="id"),
    PANEL,
    ALOUD,
    Edit("remainder"),
)
#: Symptoms come out as one section of terms and their paragraphs.
TERM_EDITS = (
    Edit("terms", tags=("div",), classes=("list-item",), title="SYMPTOMS", head=Edit("", tags=("h4",)), body=Edit("", tags=("div",), classes=("col-5",))),
    Edit("drop first", tags=("div",), id="symptoms"),
)
PLAIN_EDITS = (Edit("heading", tags=("h2",), text=r"(?s)\A.", title="[{}]"), Edit("unwrap", tags=("div",)))
LEAST_TERM_WORDS = 5


def _synonyms(line: str) -> str:
    return re.sub(r"^(?:Synonyms?:\s*)+", "Synonyms: ", line, flags=re.I) if re.match(r"synonyms?:", line, re.I) else line


def edited(root: Node, edits: tuple[Edit, ...]) -> dict[str, str]:
    """Run edits over a tree, one after the other; returns the sections that they take out of it."""
    taken: dict[str, str] = {}
    silent = lambda n: _ALOUD_WORD.sub("", n.text("\n").strip())
    for e in edits:
        if e.action == "remainder":
            if text := silent(root):
                taken[DEFAULT_TITLE] = text
            continue
        terms = []
        for n in [n for n in root.walk() if e.picks(n)]:
            if e.action == "drop" or e.action == "drop first":
                n.remove()
            elif e.action == "unwrap":
                n.unwrap()
            elif e.action == "heading":
                _mark_heading(n, e.named(n))
            elif e.action == "drop with rest":
                if n.parent is not None and n.attached():
                    del n.parent.children[n.index() :]
            else:
                head, body = n.find(e.head.picks), n.find(e.body.picks)
                if e.action == "section" and head and body and head.text() and n.attached():
                    edited(body, (ALOUD,))
                    if text := silent(body):
                        taken[e.named(head)] = text
                elif e.action == "terms" and head and body:
                    lines = [x for x in (_synonyms(p.text(" ")) for p in body.all("p")) if x]
                    if sum(len(x.split()) for x in lines) >= LEAST_TERM_WORDS:
                        terms.append(f"{head.text().upper()}:\n" + "\n".join(lines))
                n.remove()
            if e.action == "drop first":
                break
        if terms:
            taken[e.title] = "\n\n".join(terms)
    return taken


def edit_gard(root: Node) -> dict[str, str]:
    """Takes panels and symptoms out of the tree, as sections of their own."""
    main = root.find(Edit("", tags=("div",), id="MainContent").picks) or root.find(Edit("", tags=("body",)).picks) or root
    panels = root.find(PANEL.picks)
    taken = edited(main, PANEL_EDITS) if panels else {}
    taken |= edited(main, TERM_EDITS)
    if not panels:
        edited(root, PLAIN_EDITS)
    return taken


# --- main content ------------------------------------------------------------------------------------------------

_SIDE = frozenset("nav footer aside header script style noscript form button select template iframe svg figure table".split())
_HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _blocks(node: Node, out: list[tuple[str, str]]) -> None:
    for child in node.children:
        if isinstance(child, str):
            text = " ".join(child.split())
            if text:
                out.append(("p", text))
        elif child.tag in _SIDE:
            continue
        elif child.tag in _HEADS or child.tag in ("p", "li"):
            text = " ".join("".join(child.strings()).split())
            if text:
                out.append(("head" if child.tag in _HEADS else "p" if child.tag == "p" else "item", text))
        else:
            _blocks(child, out)


def content_blocks(root: Node, recall: bool = False) -> list[tuple[str, str]]:
    """(head, p or item; text) of the container whose paragraphs hold the most words outside links.

    With `recall` the whole body is taken.
    """
    body = root.find(lambda n: n.tag == "body") or root
    marked = root.find(lambda n: n.tag in ("article", "main"))
    best = marked or body
    if marked is None and not recall:
        score: dict[int, list] = {}
        for p in body.all("p", "li"):
            words = len(p.text(" ").split()) - 2 * sum(len(a.text(" ").split()) for a in p.all("a"))
            up, share, skipped = p.parent, 1.0, False
            while up is not None and up.tag != "#page":
                skipped |= up.tag in _SIDE
                up = up.parent
            up = p.parent
            while up is not None and not skipped and share > 0.1:
                score.setdefault(id(up), [0.0, up])[0] += share * words
                up, share = up.parent, share / 2
        top = max(score.values(), key=lambda x: x[0], default=None)
        if top and top[0] > 0:
            best = top[1]
    out: list[tuple[str, str]] = []
    _blocks(body if recall else best, out)
    return out


def fold_blocks(found: list[tuple[str, str]]) -> dict[str, str]:
    """Sections by heading; equal headings are one section."""
    sections: dict[str, list[str]] = {}
    title = DEFAULT_TITLE
    for kind, text in found:
        if text.startswith(HEADING_MARK):
            kind, text = "head", text[len(HEADING_MARK) :]
        if kind == "head":
            text = text.strip().upper()
            title = text if text.startswith("[") else f"[{text}]"
        else:
            sections.setdefault(title, []).append("- " + text if kind == "item" else text)
    return {k: "\n".join(v) for k, v in sections.items()}


# --- rules over sections -----------------------------------------------------------------------------------------


def lead_bullets(text: str) -> str:
    """A short bullet without a full stop leads the bullet after it: "- a", "- b" become "- a: b"."""
    lines = [x.strip() for x in text.split("\n")]
    out: list[str] = []
    waiting = iter(range(len(lines)))
    for i in waiting:
        line = lines[i]
        if line.startswith("- ") and i + 1 < len(lines) and lines[i + 1].startswith("- ") and len(line) < 100 and not line.endswith("."):
            line = f"{line}: {lines[i + 1][2:]}"
            next(waiting)
        out.append(line)
    return "\n".join(out)


def _keep_lines(text: str, drop: Callable[[str], bool]) -> str:
    return "\n".join(x for x in text.split("\n") if not drop(x.strip()))


def apply_site(sections: dict[str, str], rules: Site) -> dict[str, str]:
    out: dict[str, str] = {}
    for topic, text in sections.items():
        topic = topic.strip()
        if "REFERENCES" in topic.upper():
            continue
        text = _keep_lines(text, lambda x: "For more information" in x).strip()
        if not text:
            continue
        if any(x in topic for x in rules.stop):
            break
        if any(x in topic for x in rules.skip) or topic in rules.skip_equal:
            continue
        if len(text.split()) < rules.advert_words and any(x in text.lower() for x in rules.advert):
            continue
        text = _keep_lines(text, lambda x: x.startswith(rules.line_starts) or any(y in x for y in rules.line_holds) or rules.digit_lines and x.isdigit())
        for x in rules.cut:
            text = text.replace(x, "")
        if rules.bullets_topic and rules.bullets_topic in topic:
            text = lead_bullets(text)
        for p in rules.patterns:
            text = re.sub(p, "", text.strip())
        text = text.strip()
        if text:
            out[topic] = text
    return out


def merge_short(sections: dict[str, str], short: int = SHORT_TOPIC, merged: int = MERGED_TOPIC) -> dict[str, str]:
    """Drop topics below `short` words; fold topics of up to `merged` words into the smaller neighbour (a tie: the one before)."""
    rows = [[k, v] for k, v in sections.items() if len(v.split()) >= short]
    size = lambda i: len(rows[i][1].split()) if 0 <= i < len(rows) else float("inf")
    at = 0
    while at < len(rows):
        if size(at) > merged or len(rows) == 1:
            at += 1
            continue
        topic, text = rows[at]
        whole = f"{topic}\n{text.strip()}"
        if size(at - 1) <= size(at + 1):
            rows[at - 1][1] = f"{rows[at - 1][1].strip()}\n\n{whole}"
        else:
            rows[at + 1][1] = f"{whole}\n\n{rows[at + 1][1].strip()}"
        del rows[at]
    return dict(rows)


def gard_sections(kept: dict[str, str], taken: dict[str, str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for topic, text in kept.items():
        if "NAVIGATING HEALTH CARE DECISIONS" in topic:
            break
        out[topic] = re.sub(r"(?i)\d+\s+Symptoms", "", text).strip() if topic in ("[SYMPTOMS]", "SYMPTOMS") else text
    for topic, text in taken.items():
        if any(x in topic for x in (*GARD_NOISE, "SHOWING")) or any(x in text for x in ("Patient organizations can help patients", "Clinical studies are part of clinical research", "Showing of", "Showing 1 to")):
            continue
        text = re.sub(r"^Listen\s*", "", text.strip())
        if topic == DEFAULT_TITLE:
            for p in GARD_BOILERPLATE:
                text = p.sub("", text)
        text = _keep_lines(text, lambda x: x in GARD_LINES or "placeholder for the horizontal scroll slider" in x or x.startswith(("Other Names:", "Categories:")) or x.endswith(";") or x.lower().startswith("learn more about")).strip()
        if topic == DEFAULT_TITLE and len(text) < 50 and "." not in text:
            continue
        out[topic] = text
    return out


def final_sections(sections: dict[str, str], domain: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for topic, text in sections.items():
        name = topic.replace("[", "").replace("]", "").strip()
        if not name or "REFERENCES" in name.upper() or "cdc.gov" in domain and "EXPLORE" in name.upper():
            continue
        text = _keep_lines(text, lambda x: x.lower().startswith("learn more about") or x.startswith(("- Organizations:", "- Categories:")) or "rare-source" in x.lower() or "RESOURCE(S) FOR MEDICAL PROFESSIONALS" in x or "for more information" in x.lower()).strip()
        if text:
            out[name] = text
    return out


def extract_sections(page: str | None, domain: str | None, recall: bool = False) -> dict[str, str]:
    """Ordered {title: text} of a page; empty for null or empty pages. A page without blocks is one section."""
    if not page:
        return {}
    domain = domain or ""
    root, taken, rules = parse(page), {}, site_rules(domain)
    if "cancer.gov" in domain:
        lists_to_paragraphs(root)
    elif "ninds.nih.gov" in domain:
        edited(root, NINDS_EDITS)
    elif "niddk.nih.gov" in domain:
        edited(root, NIDDK_EDITS)
    if domain == "rarediseases.info.nih.gov":
        taken = edit_gard(root)
    found = content_blocks(root, recall)
    if not found:
        return {WHOLE_TITLE: root.text("\n")}
    sections = apply_site(fold_blocks(found), rules)
    if rules.lengths:
        sections = merge_short(sections)
    if "rarediseases.info.nih.gov" in domain:
        sections = gard_sections(sections, taken)
    return final_sections(sections, domain)


def extract(html: Column, domain: Column) -> Column:
    """struct<status, sections>: sections in page order."""

    @F.arrow_udf("struct<status:string,sections:array<struct<pos:int,section:string,text:string>>>")
    def _extract(html: pa.Array, domain: pa.Array) -> pa.Array:
        out = []
        for page, name in zip(html.to_pylist(), domain.to_pylist()):
            try:
                found = extract_sections(page, name)
                out.append({"status": "ok" if found else "empty", "sections": [{"pos": i, "section": k, "text": v} for i, (k, v) in enumerate(found.items())]})
            except Exception as e:  # whatever a page does is that page's result, not a failed job
                out.append({"status": f"error: {type(e).__name__}", "sections": []})
        item = pa.struct([("pos", pa.int32()), ("section", pa.string()), ("text", pa.string())])
        return pa.array(out, pa.struct([("status", pa.string()), ("sections", pa.list_(item))]))

    return _extract(html, domain)
