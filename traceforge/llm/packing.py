"""Packing token sequences by vector bin packing with the dot-product heuristic.

A sequence is a bin with three limits: tokens, segments and loss-bearing tokens. The open bin takes,
again and again, the example that fits and whose demand has the greatest dot product with what the
bin has left, each dimension scaled by its limit and weighted by the pool's mean demand. When nothing
fits, an example may be cut (documents; not for instruction examples) to fill the bin to the brim.

A document of more than a sequence first fills sequences of its own; its tail joins the pool. Pools
live inside the tasks of the scan: no shuffle, and memory is one pool of at most ``POOL`` tails, each of less than
a sequence, and one piece of a batch. What is
left at the end of a task makes sequences whose lengths are powers of two, so it needs no padding.

Plain documents bear loss on all tokens after a piece's first, so there the token limit alone binds, and the heuristic
places the largest fitting piece first. Instruction data (``conversation_sizes``, ``pack_examples``) has all three demands:
loss is on what the assistant says. Examples stay whole there; one without tokens, or that exceeds a limit by
itself, gets no sequence (null), for the caller to shorten.

Sequence ids are ``partition << 32 | number``; the same splits give the same sequences when a task
runs again. Of equal scores the example that came first is taken. A null text is a document of the end id alone, a null
turn has no tokens; repeated rows are packed each (of turns: count each); an empty table gives no rows; extra columns,
of any name, are not read. A document of any length is encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordids
from .textarrays import pieces


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2048


POOL, REFILL = 3000, 1500
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Examples in, (example, start, length, sequence, offset) out. ``cut`` allows to split examples; ``tail`` makes what the pool holds of one that is used up to a place."""

    def __init__(self, limits: Limits, emit: Callable[[object, int, int, int | None, int | None], None], cut: bool = True, tail: Callable[[object, int], object] | None = None):
        self.limits, self.emit, self.cut, self.tail = limits, emit, cut, tail
        self.keys: list[object] = []
        self.begin: list[int] = []
        self.tokens: list[int] = []
        self.loss: list[int] = []
        self.sequence = 0

    def add(self, key: object, tokens: int, loss: int | None = None) -> None:
        """An example. Without ``loss`` all tokens but a piece's first bear loss."""
        start, full = 0, self.limits.tokens
        if self.cut:
            while tokens - start >= full and full - 1 <= self.limits.loss_tokens:
                self.emit(key, start, full, self.sequence, 0)
                self.sequence += 1
                start += full
        elif not tokens or tokens > full or (loss or 0) > self.limits.loss_tokens:
            self.emit(key, 0, tokens, None, None)
            return
        if start < tokens:
            self.keys.append(self.tail(key, start) if self.tail else key)
            self.begin.append(start)
            self.tokens.append(tokens - start)
            self.loss.append(tokens - start - 1 if loss is None else loss)
        if len(self.keys) >= POOL:
            self.fill(REFILL)

    def fill(self, keep: int) -> None:
        """Fill sequences until at most ``keep`` examples, or less than a sequence's tokens, are left."""
        most = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], float)
        demand = np.stack([np.array(self.tokens, float), np.ones(len(self.keys)), np.array(self.loss, float)]) if self.keys else np.zeros((3, 0))
        begin, alive = np.array(self.begin, np.int64), np.ones(len(self.keys), bool)
        left, tokens = len(self.keys), float(demand[0].sum())
        weight = demand.mean(axis=1) / most if left else most
        scaled = demand / most[:, None]
        while left > keep and (tokens >= most[0] or keep == 0):
            room, offset = most.copy(), 0
            if tokens < most[0] and self.cut:
                break
            while room[0] > 0 and left:
                fits = alive & (demand[0] <= room[0]) & (demand[2] <= room[2]) & (room[1] >= 1)
                if fits.any():
                    score = (weight * room / most) @ scaled
                    score[~fits] = -1.0
                    i = int(score.argmax())
                    take = int(demand[0, i])
                    alive[i] = False
                    left -= 1
                    used = demand[:, i].copy()
                elif self.cut and room[1] >= 1 and room[2] >= 1:
                    i = int(np.where(alive, demand[0], -1.0).argmax())
                    take = int(min(room[0], room[2] + 1))
                    if take >= demand[0, i]:
                        break
                    used = np.array([take, 1.0, take - 1.0])
                else:
                    break
                self.emit(self.keys[i], int(begin[i]), take, self.sequence, offset)
                offset += take
                tokens -= take
                room -= used
                if alive[i]:
                    begin[i] += take
                    demand[0, i] -= take
                    demand[2, i] = demand[0, i] - 1
                    scaled[:, i] = demand[:, i] / most
            self.sequence += 1
        rest = np.flatnonzero(alive)
        self.keys = [self.keys[i] for i in rest]
        self.begin, self.tokens, self.loss = begin[rest].tolist(), demand[0, rest].astype(int).tolist(), demand[2, rest].astype(int).tolist()

    def end(self) -> None:
        """Pack what is left; a last partial sequence of cuttable examples becomes ones of power-of-two lengths."""
        self.fill(0)
        total, i, used = sum(self.tokens), 0, 0
        while total:
            size = 1 << (total.bit_length() - 1)
            offset = segments = 0
            while offset < size and segments < self.limits.segments:
                take = min(size - offset, self.tokens[i] - used)
                self.emit(self.keys[i], self.begin[i] + used, take, self.sequence, offset)
                offset += take
                segments += 1
                used += take
                if used == self.tokens[i]:
                    i, used = i + 1, 0
            total -= offset
            self.sequence += 1
        self.keys, self.begin, self.tokens, self.loss = [], [], [], []


def pack_documents(documents: DataFrame, limits: Limits = Limits(), tokenizer: str | None = None) -> DataFrame:
    """One row per piece of a document's ids, with its place in a sequence."""
    path = tokenizer or wordids.tokenizer_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, base = wordids.worker(path), TaskContext.get().partitionId() << 32
        out: list[tuple] = []

        def emit(key: tuple[int | None, bytes, int, int], start: int, length: int, sequence: int, offset: int) -> None:
            doc_id, ids, first, total = key
            out.append((doc_id, start, length, zlib.crc32(memoryview(ids)[4 * (start - first) : 4 * (start - first + length)]), total, base + sequence, offset, length - 1))

        def tail(key: tuple[int | None, bytes, int, int], start: int) -> tuple[int | None, bytes, int, int]:
            """The pool keeps a document's last ids alone, not those that are packed."""
            return key[0], key[1][4 * start :], start, key[3]

        def rows() -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * 8
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])
            out.clear()
            return batch

        packer = Packer(limits, emit, tail=tail)
        for b in batches:
            column = b.column("doc_id")
            for t in pieces(b.column("text"), 4 << 20):
                for doc_id, ids in zip(column.slice(t.first, len(t)).to_pylist(), w.encode(t)):
                    packer.add((doc_id, ids, 0, len(ids) // 4), len(ids) // 4)
                if out:
                    yield rows()
        packer.end()
        if out:
            yield rows()

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def conversation_sizes(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """example_id, n_tokens and n_loss_tokens of each conversation (conv_id, role, text): a turn is its text's ids and the end id; loss is on the assistant's."""
    path = tokenizer or wordids.tokenizer_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = wordids.worker(path)
        for b in batches:
            for t in pieces(b.column("text"), 4 << 20):
                own = b.slice(t.first, len(t))
                n = [len(x) // 4 if own.column("text")[i].is_valid else 0 for i, x in enumerate(w.encode(t))]
                loss = [x if role == "assistant" else 0 for x, role in zip(n, own.column("role").to_pylist())]
                yield pa.RecordBatch.from_arrays([own.column("conv_id"), pa.array(n, pa.int64()), pa.array(loss, pa.int64())], names=["example_id", "n", "loss"])

    sizes = turns.select("conv_id", "role", "text").mapInArrow(run, "example_id long, n long, loss long")
    return sizes.groupBy("example_id").agg(F.sum("n").alias("n_tokens"), F.sum("loss").alias("n_loss_tokens"))


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Instruction data: whole examples (example_id, n_tokens, n_loss_tokens) under the three limits, never cut."""
    schema = "example_id long, n_tokens long, n_loss_tokens long, sequence_id long, offset long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, out = TaskContext.get().partitionId() << 32, []
        packer = Packer(limits, lambda key, start, length, sequence, offset: out.append((*key, None if sequence is None else base + sequence, offset)), cut=False)

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names=[f.split()[0] for f in schema.split(", ")])
            out.clear()
            return batch

        for b in batches:
            for key in zip(*(b.column(k).to_pylist() for k in ("example_id", "n_tokens", "n_loss_tokens"))):
                packer.add(key, key[1] or 0, key[2] or 0)
            yield rows()
        packer.end()
        yield rows()

    return examples.select("example_id", "n_tokens", "n_loss_tokens").mapInArrow(run, schema)
