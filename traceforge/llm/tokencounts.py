"""Token counts of whole texts under a byte-level BPE vocabulary, by rank-synchronous merging of ragged arrays.

One map over the scan, no shuffle: memory is one piece of an Arrow batch (about ``PIECE`` bytes, or the longest single
text), whatever the corpus, and a lost task is run again from its own rows.

Rows and edge cases: one row for each input row, repeated rows and null or equal doc_ids included; a null or
empty text has no bytes and no tokens; texts are never cut; special strings in a text count as one token each; an
empty table gives an empty result; extra columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytepairs
from .textarrays import pieces
from .wordids import tokenizer_path

#: Bytes of text that are worked on at once.
PIECE = 2 << 20


def token_counts(documents: DataFrame, tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """Per row of ``documents``: doc_id, n_bytes, n_tokens, and whether that is over ``limit``."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = bytepairs.worker(path)
        for b in batches:
            for t in pieces(b.column("text"), PIECE):
                n = w.counts(t)
                ids = b.column("doc_id").slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(t.offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
