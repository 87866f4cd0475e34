"""Token ids of whole texts by the ``tokenizers`` library, one Arrow batch at a time.

The tokenizer file is a parameter. One that folds case, drops white space, never lets a token cross it, and splits off
punctuation, as ``word_bpe_49k.json`` does (told by its normalizer and splitting rule, ``_SPLIT``), gives a text the ids of its
white-space separated words, one after another, and those of a word are the ids of its body, if that ends in a letter or
digit of ASCII, and of the punctuation (``_CLOSING``) that ends it. Each distinct such element is encoded once per worker,
many in one call; a worker remembers at most ``KEEP`` of them and ``KEEP_BYTES``, then starts afresh. Texts of other
tokenizer files, and those that hold a special token's mark, go through the library whole. Texts are never cut.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from .textarrays import Texts

END_ID = 1
END = np.array([END_ID], "<u4").tobytes()
KEEP, KEEP_BYTES = 400_000, 64 << 20
#: The normalizer and splitting rule for which words can be encoded apart.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands between elements that are encoded together; one token of its own, and what holds it is encoded alone.
MARK = b"~"

_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?#$%&*|")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_SPACES = b" \t\n\v\f\r"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class WordIds:
    path: str
    known: dict[bytes, bytes] = field(default_factory=dict)
    held: int = 0

    def __post_init__(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.between = f" {MARK.decode()} "
        marks = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark, self.by_word = marks[0] if marks else None, len(marks) == 1 and self._splits()

    def _splits(self) -> bool:
        rules = json.loads(self.tokenizer.to_str())
        steps = [s.get("type") for s in (rules.get("normalizer") or {}).get("normalizers", [])]
        first = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        return steps == _NORMAL and first.get("pattern") == {"Regex": _SPLIT}

    def _whole(self, text: bytes) -> bytes:
        return np.array([*self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, END_ID], "<u4").tobytes()

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        known = self.known
        unseen = [w for w in dict.fromkeys(words) if w not in known]
        if (len(known) + len(unseen) > KEEP or self.held > KEEP_BYTES) and known:
            known.clear()
            self.held = 0
            unseen = list(dict.fromkeys(words))
        alone = [w for w in unseen if MARK in w]
        joined = [w for w in unseen if MARK not in w] if alone else unseen
        for w in alone:
            known[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        groups = [joined[k : k + 256] for k in range(0, len(joined), 256)]
        for k in range(0, len(groups), 16):
            some = groups[k : k + 16]
            texts = [self.between.join(w.decode() for w in g) for g in some]
            for g, e in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                cut = (4 * np.flatnonzero(ids == self.mark)).tolist()
                raw, at = ids.tobytes(), 0
                for w, end in zip(g, [*cut, len(raw)], strict=True):
                    known[w] = raw[at:end]
                    at = end + 4
        self.held += sum(len(w) + len(known[w]) for w in unseen)
        return [known[w] for w in words]

    def encode(self, t: Texts) -> list[bytes]:
        """Each row's ids, END_ID at the end included, as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [self._whole(t.text(i)) for i in range(len(t))]
        low = t.lowered()
        starts, ends, first = low.words()
        rows = len(t)
        if len(starts):
            # Where the closing punctuation of a word begins, if it has at most three characters of it.
            tail = ends.copy()
            for _ in range(3):
                tail -= _CLOSING[low.data[tail - 1]] & (tail - 1 > starts)
            split = (tail < ends) & _PLAIN[low.data[tail - 1]]
            # An element reaches to the next one's start: white space adds no ids.
            begins = np.sort(np.concatenate((starts, tail[split])), kind="stable")
            bounds = np.append(begins, len(low.data)).astype(np.int64)
            column = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(low.data)]).dictionary_encode()
            heads = np.frombuffer(column.dictionary.buffers()[1], np.int64)[: len(column.dictionary) + 1].tolist()
            body = column.dictionary.buffers()[2].to_pybytes()
            ids = np.empty(len(heads) - 1, object)
            ids[:] = self._ids([body[i:j].strip(_SPACES) for i, j in zip(heads, heads[1:])])
            each = ids[column.indices.to_numpy()].tolist()
            at = np.searchsorted(begins, t.offsets).tolist()
        else:
            each, at = [], [0] * (rows + 1)
        out = [b"".join(each[at[i] : at[i + 1]]) + END for i in range(rows)]
        if b"<|" in low.data.tobytes():
            for i in range(rows):
                text = t.text(i)
                if b"<|" in text:
                    out[i] = self._whole(text)
        return out


_workers: dict[str, WordIds] = {}


def worker(path: str) -> WordIds:
    """This process's encoder for a file."""
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]
