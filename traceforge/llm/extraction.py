"""Main text of web pages: a linear-chain CRF labels the leaf blocks, Viterbi decodes them.

Features of a block are its ancestors' tags, what their class, id and role names hint at, its length,
its share of links, how it ends, and where it stands; the chain learns that article blocks come in runs. It is
trained once per query on the driver, on ``PAGES`` generated labelled pages (a fixed, small set), and
its weights, some hundred numbers, go to the tasks. Pages are independent: no shuffle.

Rows and edge cases: a null or empty page gives an empty text; a page cut off anywhere keeps what is
readable; a very long page is read whole; repeated rows are extracted each; a tie between two labelings of a
page goes to the one that leaves blocks out; an empty table gives an empty result; null ids and urls pass through;
only page_id, url and html are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import htmlblocks
from .crf import Chain, train
from .htmlblocks import Block
from .labelledpages import labelled_pages

PAGES = 500
#: Parts of class, id and role names and what they hint at.
HINTS = {
    "text": "article content post entry story body text main page",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination tabs",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo banner promotion",
    "notice": "cookie cookies consent notice alert gdpr newsletter subscribe popup modal overlay paywall cc",
    "foot": "footer foot copyright colophon legal contentinfo bottom",
    "head": "header head masthead topbar top logo",
    "side": "sidebar side aside related widget rail recommended complementary more",
    "talk": "comment comments disqus reply replies respond discussion reader thread commentlist commentslist",
    "form": "form search login signup register input",
    "share": "share sharing social follow",
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
_KNOWN = frozenset(_HINT)


def blocks(page: str | None) -> list[Block]:
    """A page's blocks, with the marks that hint at something."""
    return htmlblocks.blocks(page, _KNOWN)


def features(found: list[Block]) -> list[list[str]]:
    """Feature names of each block of a page."""
    out = []
    for i, b in enumerate(found):
        n = b.text.count(" ") + 1
        tags, hints = b.tags, {_HINT[m] for m in b.marks if m in _HINT}
        size = next(k for k, most in (("1", 1), ("3", 3), ("9", 9), ("24", 24), ("60", 60), ("many", 1 << 60)) if n <= most)
        share = "none" if b.link_share == 0 else "some" if b.link_share < 0.4 else "most" if b.link_share < 0.9 else "all"
        f = ["bias", f"words {size}", f"links {share}", f"size and links {size} {share}", f"leaf {b.leaf}"]
        f += [f"in {t}" for t in sorted(tags)] + [f"hint {h}" for h in sorted(hints)]
        f += ["no container"] * (not tags & {"article", "main", "nav", "aside", "footer", "header", "form"} and not hints)
        f += [f"end {'stop' if b.text[-1] in '.!?:;…' else 'other'}", "sign"] if b.text[:1] == "©" else [f"end {'stop' if b.text[-1] in '.!?:;…' else 'other'}"]
        f += ["first"] * (i == 0) + ["last"] * (i == len(found) - 1)
        out.append(f)
    return out


@cache
def model() -> Chain:
    """The chain, trained on the labelled pages."""
    found = [(blocks(page), labels) for page, labels in labelled_pages(PAGES)]
    return train([features(b) for b, _ in found], [labels for _, labels in found])


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, chain.decode(features(found))) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    chain = model()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), chain) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
