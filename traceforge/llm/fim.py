"""Fill-in-the-middle: a text's parts rearranged behind sentinels, and put back in order.

Each text becomes a rope (``rope``), is split at two unit ranks, and the three trees are joined in another order
with sentinel leaves between them. The inverse takes the output and the form alone: it finds the sentinels, splits the
output's rope there and joins the parts. Texts in which a sentinel stands stay as they are ("plain"), so the
sentinels of an output are always its own; none can form across a seam, as their ends match no other's beginning.

Where a text is cut, and its form, follow from a hash of doc_id: reruns and retried tasks agree. One map, no shuffle; memory
is one Arrow batch, or the longest text.

Rows and edge cases: one row for each input row; repeated rows give equal results; a null or empty text is plain, of no
units, its output empty; a null doc_id hashes as an empty one; texts are never cut short; an empty table gives an empty result;
extra columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .rope import Leaf, Rope, chars, flat, join, rope, split, units

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Rules:
    """Sentinels, the share of texts that are rearranged, the share of these with the suffix first, and what a unit is (a pattern; None: a code point)."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    percent: int = 90
    spm_percent: int = 20
    seed: int = 1
    unit: str | None = None

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        ends = any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a != b)))
        if not all(marks) or len(set(marks)) < 3 or ends or any(a != b and a in b for a in marks for b in marks):
            raise ValueError("sentinels must differ, hold none of the others, and never end as one begins")


@dataclass(frozen=True)
class Rearranged:
    """A text's units, its form, the rearranged rope, and the parts' lengths in code points (None if plain)."""

    n: int
    form: str
    out: Rope
    prefix_chars: int | None = None
    middle_chars: int | None = None


def _mark(text: str) -> Leaf:
    return Leaf(text, 0, len(text), len(text))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2**32 that doc_id and seed fix."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def rearrange(text: str, h: list[int], rules: Rules) -> Rearranged:
    """A text under four draws: two cuts, plain or not, and which form."""
    tree = rope(text, re.compile(rules.unit, re.DOTALL) if rules.unit else None)
    n = units(tree)
    if not text or h[2] % 100 >= rules.percent or any(m in text for m in (rules.prefix, rules.suffix, rules.middle)):
        return Rearranged(n, PLAIN, tree)
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, rest = split(tree, first)
    middle, suffix = split(rest, second - first)
    p, s, m = _mark(rules.prefix), _mark(rules.suffix), _mark(rules.middle)
    form = SPM if h[3] % 100 < rules.spm_percent else PSM
    out = join(p, prefix, s, suffix, m, middle) if form == PSM else join(s, suffix, p, prefix, m, middle)
    return Rearranged(n, form, out, chars(prefix), chars(middle))


def restore(output: str, form: str, rules: Rules) -> str:
    """The text from which ``output`` came."""
    if form == PLAIN:
        return output
    order = (rules.prefix, rules.suffix, rules.middle) if form == PSM else (rules.suffix, rules.prefix, rules.middle)
    places = [output.index(m) for m in order]
    rest, parts = rope(output), []
    for m, at in zip(reversed(order), reversed(places)):
        rest, part = split(rest, at)
        parts.append(split(part, len(m))[1])
    middle, second, first = parts
    return flat(join(first, middle, second) if form == PSM else join(second, middle, first))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fim_documents(documents: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Per row of ``documents``: doc_id, n (units), form, prefix_chars, middle_chars, output, and restored, rebuilt from output and form alone."""
    rules = rules or Rules()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, STEP):
                ids = b.column("doc_id").slice(k, STEP)
                got, outs, back = [], [], []
                for i, text in zip(ids.to_pylist(), b.column("text").slice(k, STEP)):
                    r = rearrange(text.as_py() or "", draws(i, rules.seed), rules)
                    got.append(r)
                    outs.append(flat(r.out))
                    back.append(restore(outs[-1], r.form, rules))
                columns = [
                    ids, pa.array([r.n for r in got], pa.int64()), pa.array([r.form for r in got], pa.string()), pa.array([r.prefix_chars for r in got], pa.int64()),
                    pa.array([r.middle_chars for r in got], pa.int64()), pa.array(outs, pa.string()), pa.array(back, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


#: Rows that go out at once.
STEP = 256
