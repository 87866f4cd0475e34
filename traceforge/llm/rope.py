"""Texts as ropes: balanced trees of slices that know how many units and code points stand below them.

A unit is a code point, or a match of a pattern (what no match covers belongs to the unit before it, or to the
first). Splitting at a unit's rank goes down one path and makes new nodes along it alone; joining makes one node.
Trees are never changed, so halves share what they have in common.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

#: Code points, about, in a leaf.
LEAF = 2048


@dataclass(frozen=True, slots=True)
class Leaf:
    """Code points ``first`` to ``first + chars`` of ``text``; ``bounds`` are the unit starts among them, None if each is one."""

    text: str
    first: int
    chars: int
    units: int
    bounds: tuple[int, ...] | None = None

    def at(self, rank: int) -> int:
        """Code points before the unit of that rank."""
        return rank if self.bounds is None else self.bounds[rank] if rank < self.units else self.chars


@dataclass(frozen=True, slots=True)
class Node:
    left: Rope
    right: Rope
    units: int
    chars: int


Rope = Leaf | Node | None


def units(rope: Rope) -> int:
    return rope.units if rope else 0


def chars(rope: Rope) -> int:
    return rope.chars if rope else 0


def join(*parts: Rope) -> Rope:
    """Ropes one after another; empty ones vanish."""
    out: Rope = None
    for p in parts:
        out = p if out is None else out if p is None else Node(out, p, out.units + p.units, out.chars + p.chars)
    return out


def _balanced(leaves: list[Leaf]) -> Rope:
    level: list[Rope] = list(leaves)
    while len(level) > 1:
        level = [join(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0] if level else None


def rope(text: str, unit: re.Pattern[str] | None = None, leaf: int = LEAF) -> Rope:
    """The rope of a text, with leaves of about ``leaf`` code points that end where units do."""
    if not text:
        return None
    if unit is None:
        return _balanced([Leaf(text, i, n, n) for i in range(0, len(text), leaf) for n in [min(leaf, len(text) - i)]])
    starts = [m.start() for m in unit.finditer(text) if m.end() > m.start()] or [0]
    starts[0] = 0
    leaves, i = [], 0
    while i < len(starts):
        k = i + 1
        while k < len(starts) and starts[k] - starts[i] < leaf:
            k += 1
        end = starts[k] if k < len(starts) else len(text)
        leaves.append(Leaf(text, starts[i], end - starts[i], k - i, tuple(s - starts[i] for s in starts[i:k])))
        i = k
    return _balanced(leaves)


def split(tree: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` units, and the rest."""
    if tree is None or rank <= 0:
        return None, tree
    if rank >= tree.units:
        return tree, None
    if isinstance(tree, Node):
        if rank < tree.left.units:
            a, b = split(tree.left, rank)
            return a, join(b, tree.right)
        a, b = split(tree.right, rank - tree.left.units)
        return join(tree.left, a), b
    at = tree.at(rank)
    left, right = (None, None) if tree.bounds is None else (tree.bounds[:rank], tuple(x - at for x in tree.bounds[rank:]))
    return Leaf(tree.text, tree.first, at, rank, left), Leaf(tree.text, tree.first + at, tree.chars - at, tree.units - rank, right)


def slices(tree: Rope) -> Iterator[str]:
    """The leaves' texts in order."""
    stack = [tree]
    while stack:
        t = stack.pop()
        if isinstance(t, Node):
            stack += [t.right, t.left]
        elif t is not None:
            yield t.text[t.first : t.first + t.chars]


def flat(tree: Rope) -> str:
    return "".join(slices(tree))
