"""Byte-level byte-pair counts over whole Arrow batches: no text, word or symbol is visited by a Python loop.

A tokenizer file (``tokenizers`` JSON, byte-level BPE) gives the merge ranks, the ids of the 256 bytes, the special
strings, and, by asking its own splitting step, whether a character is a letter, a number, white space or another: its
Unicode version counts, not Python's. Each distinct character beyond ASCII is asked about once per worker.

Pre-tokens are found by comparing neighbouring classes. The distinct ones of a batch stand in one flat array of symbols,
with the place where each sequence begins. A round finds each sequence's lowest-ranked pair and joins every place where
it stands (of overlapping ones each second, from the left), in all sequences at once; sequences without a known pair
leave with the number of symbols that they have. What is still there after ``ROUNDS`` rounds, so only very long
pre-tokens, goes rank by rank, a rank's places in all sequences at once. This equals joining one pair after another, as a pair's rank is
always above those of the pairs that made its halves, which is checked when the file is read.
"""

from __future__ import annotations

import bisect
import heapq
import json
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .textarrays import Texts

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
#: The splitting pattern's short endings after an apostrophe.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: No pair of the tokenizer.
NONE = np.int32(2**31 - 1)
#: After so many rounds the sequences that are left, long ones, are joined rank by rank.
ROUNDS = 40


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@dataclass
class Spans:
    """Byte spans of pre-tokens in a flat array, and each row's first one."""

    data: np.ndarray
    starts: np.ndarray
    first: np.ndarray


class BytePairs:
    """Token counts as the file's own library gives them, without added special tokens."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model, split = rules["model"], rules.get("pre_tokenizer") or {}
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model.get("type") != "BPE" or any(model.get(k) for k in odd) or rules.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in rules["added_tokens"]):
            raise ValueError("special strings that take in their surroundings aren't supported")
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        specials = sorted((t["content"].encode() for t in rules["added_tokens"]), key=len, reverse=True)
        self.specials = re.compile(b"|".join(map(re.escape, specials))) if specials else None
        ids = model["vocab"]
        self.byte_ids = np.array([ids[c] for c in byte_letters()], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([ids[f(m)] for m in merges], np.int64) for f in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        self.width = max(ids.values()) + 1
        born = np.full(self.width, -1)
        born[made] = np.arange(len(made))
        if len(set(made.tolist())) < len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("merges aren't in an order in which pairs can be joined together")
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made.astype(np.int32)
        # Pairs of single bytes, most of what is asked, go by a table.
        self.of_bytes = np.full((256, 256), NONE, np.int32)
        byte_of = np.full(self.width, -1)
        byte_of[self.byte_ids] = np.arange(256)
        small = (byte_of[left] >= 0) & (byte_of[right] >= 0)
        self.of_bytes[byte_of[left[small]], byte_of[right[small]]] = np.flatnonzero(small)
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self._ask(np.arange(128))

    # ---- splitting

    def _ask(self, points: np.ndarray) -> None:
        """Learn the classes of code points from where the library splits around them."""
        for k in range(0, len(points), 1 << 14):
            some = points[k : k + (1 << 14)]
            text = "".join(f"a{chr(c)}1!{chr(c)}!" for c in some.tolist())
            new = np.zeros(len(text) + 1, bool)
            new[[at[0] for _, at in self.splitter.pre_tokenize_str(text)]] = True
            at = 6 * np.arange(len(some))
            kind = np.select([~new[at + 1], ~new[at + 2], ~new[at + 4]], [LETTER, NUMBER, OTHER], SPACE)
            # A blank joins what follows it, also a number or another character.
            self.classes[some] = np.where(some == 0x20, SPACE, kind)

    def spans(self, t: Texts) -> Spans:
        """The pre-tokens of some texts: each reaches to the next one's start."""
        data = t.data
        if not len(data):
            return Spans(data, np.zeros(0, np.int64), np.zeros(len(t) + 1, np.int64))
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        if len(lead) == len(data):
            points = data
        else:
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
            seen = np.flatnonzero(np.bincount(points[points > 127], minlength=0x110000))
            self._ask(seen[self.classes[seen] == UNKNOWN])
        kind, n = self.classes[points], len(points)
        edge = np.zeros(n + 1, bool)  # a row begins or ends here
        edge[np.searchsorted(lead, t.offsets)] = True
        new = edge.copy()
        new[1:n] |= kind[1:] != kind[:-1]
        # White space: the last one before text stands apart, or joins it if it is a blank.
        space = kind == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n])
        new[last] = True
        new[last[points[last] == 0x20] + 1] = False
        # An apostrophe on its own, after no blank, takes a short ending with it.
        mark = np.flatnonzero((points[:-1] == 0x27) & new[:n][:-1])
        mark = mark[(kind[mark + 1] == LETTER) & ~edge[mark + 1]]
        padded = np.append(points, np.zeros(2, points.dtype))
        reach = np.append(np.flatnonzero(edge), n)
        left = reach[np.searchsorted(reach, mark, side="right")] - mark - 1
        for e in ENDINGS:
            here = left >= len(e)
            for i, c in enumerate(e):
                here &= padded[np.minimum(mark + 1 + i, n + 1)] == c
            at = mark[here]
            new[at + 1] = False
            new[at + 1 + len(e)] = True
        new[n] = False
        starts = lead[new[:n]]
        return Spans(data, starts, np.searchsorted(starts, t.offsets))

    # ---- joining

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def sizes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many symbols are left of each byte span, spans of one after another."""
        out = np.zeros(len(starts), np.int64)
        alive = np.flatnonzero(ends > starts)
        size = (ends - starts)[alive]
        first = np.cumsum(size) - size  # where each sequence begins
        raw = data[np.repeat(starts[alive] - first, size) + np.arange(size.sum())] if len(alive) else data[:0]
        symbols = self.byte_ids[raw]
        # rank[i] is that of symbols i and i + 1; none at a sequence's end.
        rank = np.full(len(raw), NONE, np.int32)
        if len(raw):
            rank[:-1] = self.of_bytes[raw[:-1], raw[1:]]
            rank[first + size - 1] = NONE
        rounds = 0
        while len(alive):
            if rounds == ROUNDS:
                out[alive] = self._by_rank(symbols, rank, first, size)
                break
            rounds += 1
            least = np.minimum.reduceat(rank, first)
            done = least == NONE
            if done.any():
                out[alive[done]] = size[done]
                keep = np.repeat(~done, size)
                symbols, rank = symbols[keep], rank[keep]
                alive, size, least = alive[~done], size[~done], least[~done]
                if not len(alive):
                    break
                first = np.cumsum(size) - size
            at = np.flatnonzero(rank == np.repeat(least, size))
            # Of places in a row that overlap, every second one from the left.
            chain = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(chain, np.diff(chain, append=len(at)))) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            gone = np.zeros(len(symbols) + 1, np.int64)
            np.cumsum(~keep, out=gone[1:])
            size = size - (gone[first + size] - gone[first])
            symbols, rank, at = symbols[keep], rank[keep], at - gone[at]
            first = np.cumsum(size) - size
            # Pairs that a joined symbol ends or begins, but for those that would cross sequences.
            near = np.zeros(len(symbols), bool)
            near[at] = True
            near[at - 1] = True
            rank[near] = NONE
            near[first + size - 1] = False
            near = np.flatnonzero(near)
            rank[near] = self._rank(symbols[near], symbols[near + 1])
        return out

    def _by_rank(self, symbols: np.ndarray, rank: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What is left of each sequence, for few long ones: each rank once, in ascending order, wherever it stands in any of them.

        Symbols stay where they are, linked to their neighbours, so a rank costs what it changes and not the length.
        """
        n = len(symbols)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        opens = np.zeros(n, bool)
        opens[first] = True
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[at], prepend=-1))
            for r, some in zip(rank[at[cuts]].tolist(), np.split(at, cuts[1:])):
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(some)

        note(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.sort(np.concatenate(places.pop(r)))
            at = at[(rank[at] == r) & (np.diff(at, prepend=-1) > 0)]
            if not len(at):
                continue
            chain = np.flatnonzero(np.append(True, after[at[:-1]] != at[1:]))
            at = at[(np.arange(len(at)) - np.repeat(chain, np.diff(chain, append=len(at)))) % 2 == 0]
            right = after[at]
            far = after[right]
            symbols[at] = self.made[r]
            alive[right], rank[right], after[at] = False, NONE, far
            inside = far < n
            before[far[inside]] = at[inside]
            ended = ~inside
            ended[inside] = opens[far[inside]]
            rank[at] = NONE
            go = at[~ended]
            rank[go] = self._rank(symbols[go], symbols[after[go]])
            back = before[at]
            back = back[(back >= 0) & ~opens[at]]
            rank[back] = self._rank(symbols[back], symbols[after[back]])
            note(np.concatenate((go, back)))
        total = np.append(0, np.cumsum(alive))
        return total[first + size] - total[first]

    def _rows(self, t: Texts) -> np.ndarray:
        """Tokens of each row, special strings aside."""
        s = self.spans(t)
        if not len(s.starts):
            return np.zeros(len(t), np.int64)
        bounds = np.append(s.starts, len(s.data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(s.starts), [None, pa.py_buffer(bounds), pa.py_buffer(s.data)]).dictionary_encode()
        heads = np.frombuffer(words.dictionary.buffers()[1], np.int64)[: len(words.dictionary) + 1]
        body = np.frombuffer(words.dictionary.buffers()[2], np.uint8)
        each = self.sizes(body, heads[:-1], heads[1:])[words.indices.to_numpy()]
        total = np.zeros(len(each) + 1, np.int64)
        np.cumsum(each, out=total[1:])
        return total[s.first[1:]] - total[s.first[:-1]]

    def counts(self, t: Texts) -> np.ndarray:
        """Tokens of each row. A special string is one, and ends the text before it."""
        if self.specials is None:
            return self._rows(t)
        found, at, raw, ends = [], 0, t.data.tobytes(), t.offsets.tolist()
        while m := self.specials.search(raw, at):
            inside = m.end() <= ends[bisect.bisect_right(ends, m.start())]
            at = m.end() if inside else m.start() + 1  # one that would cross two rows is none
            if inside:
                found.append(m.span())
        if not found:
            return self._rows(t)
        cuts = np.array(found, np.int64)
        # Rows are cut at special strings, whose bytes form rows of their own that count one.
        bounds = np.unique(np.concatenate((t.offsets, cuts.ravel())))
        owner = np.searchsorted(t.offsets, bounds[:-1], side="right") - 1
        each = self._rows(Texts(0, t.data, bounds))
        each[np.searchsorted(bounds, cuts[:, 0])] = 1
        return np.bincount(owner, each, len(t)).astype(np.int64)


_workers: dict[str, BytePairs] = {}


def worker(path: str) -> BytePairs:
    """This process's counter for a file."""
    if path not in _workers:
        _workers[path] = BytePairs(path)
    return _workers[path]
