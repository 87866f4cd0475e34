"""Pages as leaf blocks: the text between block-level tags, with its ancestors and how much of it is links.

A tag-soup reader: unclosed and misnested tags, missing ends and cut-off pages never fail; what
stands in scripts, styles, titles, templates, comments and other unseen elements is no text. A head ends at
the first text or element that can't stand in it. A page's formulas are text, their machine annotations are not.
Work and memory grow with the page's length, not with its depth.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Comments, CDATA, declarations and tags. In a tag a quote opens a string only where a value begins, after "=".
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"""
    r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*)?)*)(>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mspace mstyle semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style title template noscript iframe svg annotation annotation-xml object head textarea select option canvas audio video".split())
_RAW = frozenset("script style title template noscript iframe textarea".split())
#: What may stand in a head; any other element, and text, ends it.
_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
#: What a start tag closes if it is open.
_CLOSES = {"li": ("li", "p"), "p": ("p",), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "body": ("head",)}
#: Elements beyond which nothing is closed by a start tag.
_WALLS = frozenset("table ul ol dl article section div main aside nav header footer form body".split())


@dataclass
class Block:
    """``leaf`` is the innermost open element, ``tags`` all open ones, ``marks`` the known parts of their class, id and role names."""

    text: str
    leaf: str
    tags: frozenset[str]
    marks: frozenset[str]
    link_share: float


class _Open:
    """The open elements: which are open is known without looking through them, however deep they are."""

    def __init__(self, known: frozenset[str]) -> None:
        self.known = known
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.tags: Counter[str] = Counter()
        self.marks: Counter[str] = Counter()
        self.unseen = 0
        self._sets: tuple[frozenset[str], frozenset[str]] | None = None

    def push(self, name: str, marks: tuple[str, ...]) -> None:
        marks = tuple(m for m in marks if m in self.known)
        self.places.setdefault(name, []).append(len(self.stack))
        if name in _WALLS:
            self.walls.append(len(self.stack))
        self.stack.append((name, marks))
        self.unseen += name in _UNSEEN
        if not self.tags[name] or any(not self.marks[m] for m in marks):
            self._sets = None
        self.tags[name] += 1
        self.marks.update(marks)

    def _pop(self) -> None:
        name, marks = self.stack.pop()
        self.places[name].pop()
        if name in _WALLS:
            self.walls.pop()
        self.unseen -= name in _UNSEEN
        for counts, keys in ((self.tags, (name,)), (self.marks, marks)):
            for k in keys:
                counts[k] -= 1
                if not counts[k]:
                    del counts[k]
                    self._sets = None

    def close(self, name: str, walls: bool) -> None:
        """Close the innermost ``name`` and what is open in it; with ``walls`` only if no wall stands in it."""
        places = self.places.get(name)
        if not places or (walls and self.walls and self.walls[-1] > places[-1]):
            return
        for _ in range(len(self.stack) - places[-1]):
            self._pop()

    def in_head(self) -> bool:
        return bool(self.stack) and self.stack[-1][0] == "head"

    def sets(self) -> tuple[frozenset[str], frozenset[str]]:
        if self._sets is None:
            self._sets = frozenset(self.tags), frozenset(self.marks)
        return self._sets


def blocks(page: str | None, known: frozenset[str] = frozenset()) -> list[Block]:
    """The page's leaf blocks that have text, in page order. ``known``: the parts of names that count as marks."""
    out: list[Block] = []
    open_ = _Open(known)
    texts: list[tuple[str, bool]] = []
    page = page or ""
    at = 0

    def flush() -> None:
        nonlocal texts
        whole = _SPACE.sub(" ", "".join(t for t, _ in texts)).strip() if texts else ""
        if whole:
            linked = sum(len(t.strip()) for t, a in texts if a)
            total = sum(len(t.strip()) for t, _ in texts)
            out.append(Block(whole, open_.stack[-1][0] if open_.stack else "none", *open_.sets(), linked / max(1, total)))
        texts = []

    def say(text: str) -> None:
        if open_.in_head() and text.strip():
            open_.close("head", False)
        if text and not open_.unseen:
            # Each run of text is decoded on its own: a reference never spans a tag.
            texts.append((html.unescape(text), "a" in open_.tags))

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None or not m[4]:  # a comment or declaration, or a tag that the page's end cuts off
            continue
        name = m[2].lower()
        if not m[1] and name not in _HEAD and open_.in_head():
            open_.close("head", False)
        if name == "br":
            say(" ")
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        if name not in _INLINE:
            flush()
        if m[1]:
            open_.close(name, False)
            continue
        for other in _CLOSES.get(name, ("p",) if name not in _INLINE else ()):
            open_.close(other, True)
        marks = tuple(p for _, v in _ATTRIBUTE.findall(m[3]) for p in _PART.findall(v.lower()))
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif not m[3].endswith("/") or name in _INLINE:
            open_.push(name, marks)
    flush()
    return out
