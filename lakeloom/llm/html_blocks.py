"""Cut a page into leaf blocks: text between block boundaries, with the path of open tags."""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

#: Elements that stay inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset("math semantics mrow mi mn mo ms mtext mspace mstyle mfrac msqrt mroot msup msub msubsup mover munder munderover mtable mtr mtd".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page. Raw ones have no tags inside and run to the end of the page if nothing
#: ends them; of the others a tag without its end tag hides nothing. A tag closed in itself hides nothing either.
RAW = frozenset("script style textarea iframe".split())
HIDDEN = frozenset("noscript template svg object canvas select annotation annotation-xml".split())
#: A new block ends an open paragraph; a new item ends an open one of these kinds in the same list or table.
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot select body html div article section main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>",
    re.S | re.I,
)
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


#: Cells that the marks of a path are hashed to.
PATH_BINS = 80


@functools.lru_cache(20_000)
def _cells(mark: str) -> tuple[tuple[int, int], ...]:
    """Two cells a mark, so that two marks rarely look alike, with a sign each."""
    hashes = [zlib.crc32((salt + mark).encode()) for salt in "#$"]
    return tuple((h % PATH_BINS, 1 if h >> 16 & 1 else -1) for h in hashes)


@dataclass(slots=True)
class Element:
    """An open element; a path is a chain of them, so that blocks share what they have in common."""

    tag: str
    marks: list[str]  # its tag name and name=word attributes; inline elements have none
    parent: Element | None


@dataclass(slots=True)
class Block:
    element: Element | None
    text: str
    link_chars: int
    cells: np.ndarray  # hashed distinct marks of the path

    @property
    def path(self) -> list[str]:
        """Tag names and name=word attributes, from the root."""
        chain, e = [], self.element
        while e:
            chain.append(e.marks)
            e = e.parent
        return [x for marks in reversed(chain) for x in marks]


class _Open:
    """Open elements with what is asked about them, each step in time that doesn't grow with their number."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.at: dict[str, list[int]] = {}  # depths of the open elements of a tag
        self.outer: list[int] = []  # depths of those that aren't inline
        self.held: dict[str, int] = {}  # open elements with a mark
        self.cells = np.zeros(PATH_BINS, np.int16)

    def depth(self, tags: Iterable[str]) -> int:
        """Depth of the innermost open element of these tags, -1 without one."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def push(self, tag: str, marks: list[str]) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.outer.append(len(self.stack))
            marks = [tag, *marks]
        else:
            marks = []
        self.stack.append(Element(tag, marks, self.stack[-1] if self.stack else None))
        for m in marks:
            self.held[m] = self.held.get(m, 0) + 1
            if self.held[m] == 1:
                for i, sign in _cells(m):
                    self.cells[i] += sign

    def close(self, upto: int) -> None:
        while len(self.stack) > upto:
            e = self.stack.pop()
            self.at[e.tag].pop()
            if e.marks:
                self.outer.pop()
            for m in e.marks:
                self.held[m] -= 1
                if not self.held[m]:
                    del self.held[m]
                    for i, sign in _cells(m):
                        self.cells[i] -= sign


def _marks(attributes: str) -> list[str]:
    out = []
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            out += [f"{name.lower()}={w}" for w in re.split(r"[^a-z0-9]+", (a or b or c).lower()) if w]
    return out


def _tokens(page: str) -> list[tuple[int, int, str, str, str]]:
    """(start, stop, tag, slash of an end tag, attributes) of each token; hidden content is part of its start tag's."""
    found: list[tuple[int, int, str, str, str]] = []
    opened: dict[str, list[int]] = {}
    stops: dict[int, int] = {}
    at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        tag, slash, attributes = (m[2] or m[5] or "").lower(), m[1] or m[4] or "", m[3] or m[6] or ""
        if tag in RAW and not slash and not _SELF_CLOSED.search(attributes):
            end = _RAW_END[tag].search(page, at)
            at = stops[len(found)] = end.end() if end else len(page)
        elif tag in HIDDEN and slash:
            if opened.get(tag):
                stops[opened[tag].pop()] = at
        elif tag in HIDDEN and not _SELF_CLOSED.search(attributes):
            opened.setdefault(tag, []).append(len(found))
        found.append((m.start(), at, tag, slash, attributes))
    out, upto = [], 0
    for k, token in enumerate(found):
        if token[0] >= upto:
            upto = stops.get(k, token[1])
            out.append((token[0], upto, "" if k in stops else token[2], " " if k in stops else token[3], token[4]))
    return out


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order. Broken markup is read as far as it goes; time is in proportion to the page."""
    out: list[Block] = []
    tree = _Open()
    parts: list[str] = []
    link_chars = 0

    def flush() -> None:
        nonlocal parts, link_chars
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(tree.stack[-1] if tree.stack else None, text, link_chars, tree.cells.copy()))
        parts, link_chars = [], 0

    def add(text: str) -> None:
        nonlocal link_chars
        if text:
            text = html.unescape(text)
            parts.append(text)
            if tree.at.get("a"):
                link_chars += len(text)

    at = 0
    for start, stop, tag, ending, attributes in _tokens(page):
        add(page[at:start])
        at = stop
        if not tag:
            parts.append(ending)
            continue
        inline = tag in INLINE
        if tag == "br":
            parts.append(" ")
            continue
        if not inline:
            flush()
        if ending:
            depth = tree.depth((tag,))
            if depth >= 0 and not (inline and tree.outer and tree.outer[-1] > depth):
                tree.close(depth)
            continue
        if not inline:
            depth = tree.depth(("p", *ITEMS.get(tag, ())))
            if depth > tree.depth(HOLDERS):
                tree.close(depth)
        if tag not in VOID and not attributes.endswith("/"):
            tree.push(tag, _marks(attributes))
    add(page[at:])
    flush()
    return out
