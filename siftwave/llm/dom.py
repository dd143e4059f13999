"""Pages as trees: elements with their marks, and text blocks in page order."""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass, field

import xxhash

ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
PART = re.compile(rf"<!--|<!|<\?|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
WORD = re.compile(r"[a-z]+")
SPACES = re.compile(r"[\s\x1c-\x1f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript xmp".split())  # up to their end tag they hold no tags
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}  # open elements that a tag ends
WITHIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}  # up to these
NEARBY = 64  # levels that are looked through for such an element, and inline elements in each other

# Names in tags, classes, ids and roles that say what a branch is.
NOISE_TAGS = frozenset("nav aside footer form button menu dialog fieldset svg math object canvas audio video select option datalist template".split())
NOISE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs footer foot"
    " masthead topbar toolbar sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe"
    " signup login search form forms comment comments respond reply replies disqus discussion share sharing social related recommended pagination pager copyright legal skip"
    " contentinfo complementary".split()
)
TALK_WORDS = frozenset("comment comments respond reply replies disqus discussion".split())
HEAD_WORDS = frozenset("header head".split())  # of the site; inside an article they hold its heading
CONTENT_TAGS = frozenset(["article", "main"])
CONTENT_WORDS = frozenset("article main content post entry story".split())
NEUTRAL, NOISE, CONTENT, HEAD = 0, 1, 2, 3


@dataclass
class Element:
    name: str
    parent: int
    path: int  # hash of the presentations from the root
    mark: int
    talk: bool  # named as reader comments
    inline: int  # inline elements right around it, itself included
    style: list[int] = field(default_factory=list)  # presentations of the children, in order
    texts: int = 0  # own text blocks


@dataclass
class Page:
    elements: list[Element]
    blocks: list[tuple[int, str]]  # element and text, in page order


def clean(text: str) -> str:
    return SPACES.sub(" ", references.unescape(text) if "&" in text else text).strip()


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), value.strip("\"'"))
    return out


def _presentation(name: str, attributes: dict[str, str]) -> tuple[str, int, bool]:
    """``(presentation, mark, talk)``: tag and classes, digits aside, and what its names say."""
    if not attributes and name not in NOISE_TAGS and name not in CONTENT_TAGS and name != "header":
        return name, NEUTRAL, False
    named = " ".join(attributes.get(a, "") for a in ("class", "id", "role")).lower()
    words = set(WORD.findall(named))
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    talk = bool(words & TALK_WORDS)
    root = name in ("html", "body")
    if root:
        mark = NEUTRAL
    elif hidden or name in NOISE_TAGS or talk:
        mark = NOISE
    elif name in CONTENT_TAGS:
        mark = CONTENT
    elif words & NOISE_WORDS:
        mark = NOISE
    elif name == "header" or words & HEAD_WORDS:
        mark = HEAD
    else:
        mark = CONTENT if words & CONTENT_WORDS else NEUTRAL
    return f"{name}.{' '.join(sorted(words))}", mark, talk and not root


def digest(value: str | bytes, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(value, seed) >> 1


def _ends(name: str) -> re.Pattern:
    if name not in _end_tags:
        _end_tags[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I)
    return _end_tags[name]


_end_tags: dict[str, re.Pattern] = {}


class _Builder:
    def __init__(self, host: str):
        self.elements = [Element("", -1, digest(host), NEUTRAL, False, 0)]
        self.open, self.names, self.blocks, self.pending = [0], {}, [], []

    def flush(self) -> None:
        """Ends the text block that was being read."""
        if self.pending:
            text = clean("".join(self.pending))
            self.pending.clear()
            if text:
                owner = self.open[-1]
                while self.elements[owner].inline and self.elements[owner].mark == NEUTRAL:
                    owner = self.elements[owner].parent
                self.elements[owner].texts += 1
                self.blocks.append((owner, text))

    def shut(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.names[self.elements[i].name] -= 1
        del self.open[depth:]

    def begin(self, name: str, attributes: str) -> None:
        presentation, mark, talk = _presentation(name, _attributes(attributes) if attributes.strip(" /") else {})
        inline = name in INLINE
        if not inline or mark != NEUTRAL:
            self.flush()
        if not inline:
            self.make_room(name)
        parent = self.elements[self.open[-1]]
        around = parent.inline + 1 if inline else 0
        if around > NEARBY:
            return
        parent.style.append(digest(presentation))
        self.elements.append(Element(name, self.open[-1], digest(presentation, parent.path), mark, talk, around))
        self.open.append(len(self.elements) - 1)
        self.names[name] = self.names.get(name, 0) + 1

    def make_room(self, name: str) -> None:
        """Ends the paragraph or list item that can't go on around this element."""
        for depth in range(len(self.open) - 1, max(0, len(self.open) - NEARBY), -1):
            above = self.elements[self.open[depth]]
            if above.name in CLOSES.get(name, ()):
                self.shut(depth)
            elif above.name == "p":
                self.shut(depth)
                if name not in CLOSES:
                    return
            elif above.name in WITHIN.get(name, ()) or not above.inline and name not in CLOSES:
                return

    def finish(self, name: str) -> None:
        inline = name in INLINE
        if not inline:
            self.flush()
        if not self.names.get(name):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            at = self.elements[self.open[depth]]
            if at.name == name:
                if any(self.elements[i].mark != NEUTRAL for i in self.open[depth:]):
                    self.flush()
                self.shut(depth)
                return
            if inline and not at.inline:  # an inline end tag ends no block
                return


def parse(html: str, host: str) -> Page:
    """Tree of a page; unclosed, stray and wrongly nested tags are mended, no text outside raw elements is lost."""
    tree, at, end = _Builder(host), 0, len(html)
    while at < end:
        m = PART.search(html, at)
        if m is None:
            tree.pending.append(html[at:])
            break
        if m.start() > at:
            tree.pending.append(html[at : m.start()])
        at = m.end()
        if m.group(2) is None:  # a comment, a declaration
            mark = "-->" if m.group(0) == "<!--" else ">"
            stop = html.find(mark, at)
            at = end if stop < 0 else stop + len(mark)
            continue
        name = m.group(2).lower()
        if name in RAW:
            tree.flush()
            if not m.group(1):
                shut = _ends(name).search(html, at)
                at = end if shut is None else shut.end()
        elif m.group(1):
            tree.finish(name)
        elif name in VOID:
            if name not in INLINE:
                tree.flush()
        else:
            tree.begin(name, m.group(3))
    tree.flush()
    return Page(tree.elements, tree.blocks)
