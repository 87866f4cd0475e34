"""Token-id files: ids in ascending doc_id order, each document compressed on its own with a shared zstandard dictionary.

Layout of a file set (a folder that executors share, written with Spark's committer, so a lost
executor leaves no half file behind):

* ``dictionary`` - one row: the dictionary, its SHA-256, and the width of an id in bytes;
* ``blocks`` - one row per block of about ``BLOCK_BYTES``: its partition and number there, the ids
  of that partition before it, the dictionary's hash, the least and greatest doc_id, and parallel
  arrays over its documents (doc_id, number of ids, end offset in ``payload``). ``payload`` holds one
  zstandard frame per document, so one document is read by one slice and one decompression.

The dictionary is trained on ``SAMPLE`` documents, those with the least hashes of id and text; of one with over
``STRETCH`` bytes of ids a stretch is taken that starts anywhere in it, by the same hash. A few documents
make a small dictionary; where there are too few to train on, their ids themselves are the dictionary. Every
document is encoded and written. Order comes from one range exchange of the texts, into partitions of about
``PARTITION_BYTES``; where a document starts follows from their totals, a table of one row per partition.

Rows and edge cases: a null text counts as empty and holds only the end id; null doc_ids come first;
repeated rows are written each, those of one doc_id in the order of their texts' hashes; an empty table gives an
empty dictionary, no blocks and an empty result; extra columns, of any name, are ignored. Any single text must fit a worker's memory, blocks are bounded.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import wordids
from .scratch import shared_dir
from .textarrays import pieces

SAMPLE, DICTIONARY_BYTES, LEVEL, BLOCK_BYTES = 1000, 64 << 10, 3, 4 << 20
STRETCH = 1 << 14  # bytes of ids that the training sample takes of a document
PARTITION_BYTES = 64 << 20

BLOCKS = (
    "part int, block int, before long, n_ids long, dictionary_hash string, min_doc_id long, max_doc_id long, "
    "doc_ids array<long>, counts array<long>, ends array<long>, payload binary"
)


@dataclass(frozen=True)
class TokenFiles:
    folder: str

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(BLOCKS).parquet(f"{self.folder}/blocks")

    def dictionary(self, spark: SparkSession) -> tuple[bytes, str, int]:
        row = spark.read.parquet(f"{self.folder}/dictionary").first()
        return bytes(row["bytes"]), row["hash"], row["width"]


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _wide(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def train_dictionary(documents: DataFrame, path: str, width: int) -> bytes:
    """A dictionary from at most ``SAMPLE`` serialized id arrays; empty only if no document has ids."""
    key = F.xxhash64("doc_id", "text")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = wordids.worker(path)
        for b in batches:
            for t in pieces(b.column("text")):
                got = []
                for h, raw in zip(b.column("h").slice(t.first, len(t)).to_pylist(), w.encode(t)):
                    ids = _narrow(raw, width)
                    at = h % max(1, (len(ids) - STRETCH) // width) * width if len(ids) > STRETCH else 0
                    got.append(ids[at : at + STRETCH])
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], names=["ids"])

    # The least hashes of each task, then of all: no sort of the table.
    least = documents.where(F.length("text") > 0).select(key.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h").alias("most")).first()["most"]
    if least is None:
        return b""
    drawn = documents.withColumn("h", key).where((F.col("h") <= least) & (F.length("text") > 0)).dropDuplicates(["h"]).select("h", "text")
    samples = sorted(bytes(r["ids"]) for r in drawn.mapInArrow(encode, "ids binary").collect())
    whole = b"".join(samples)
    size = min(DICTIONARY_BYTES, max(1 << 10, len(whole) // 8))
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few to find what they share
        return whole[:size]


def write_files(documents: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> TokenFiles:
    """Encode ``documents`` (doc_id, text) and write a file set, by default to a new folder in the shared one."""
    spark = documents.sparkSession
    path = tokenizer or wordids.tokenizer_path()
    folder = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    documents = documents.select("doc_id", "text")
    width = 2 if wordids.worker(path).tokenizer.get_vocab_size() <= 1 << 16 else 4
    dictionary = train_dictionary(documents, path, width)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary), width)], "hash string, bytes binary, width int").coalesce(1).write.parquet(f"{folder}/dictionary")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = wordids.worker(path)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids, counts, frames, size = [], [], [], 0

        def full() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = {
                "part": part, "block": block, "before": before, "n_ids": sum(counts), "dictionary_hash": name,
                "min_doc_id": min(known, default=None), "max_doc_id": max(known, default=None), "doc_ids": ids, "counts": counts,
                "ends": np.cumsum([len(f) for f in frames]).tolist(), "payload": b"".join(frames),
            }
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

        for b in batches:
            column = b.column("doc_id")
            for t in pieces(b.column("text"), 4 << 20):
                for i, raw in zip(column.slice(t.first, len(t)).to_pylist(), w.encode(t)):
                    frame = pack.compress(_narrow(raw, width))
                    ids.append(i)
                    counts.append(len(raw) // 4)
                    frames.append(frame)
                    size += len(frame)
                    if size >= BLOCK_BYTES:
                        yield full()
                        before += sum(counts)
                        block += 1
                        ids, counts, frames, size = [], [], [], 0
        if ids:
            yield full()

    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    # The text's hash orders repeated ids, and splits them over partitions if they are many.
    ordered = documents.withColumn("_tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    ordered.mapInArrow(encode, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    return TokenFiles(folder)


def _frames(dictionary: bytes, name: str):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    unpack = zstandard.ZstdDecompressor(dict_data=shared)

    def read(row_hash: str, frame: bytes) -> bytes:
        if row_hash != name:
            raise ValueError(f"block was written with dictionary {row_hash}, not {name}")
        return unpack.decompress(frame)

    return read


def read_digests(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Every document as read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    dictionary, name, width = files.dictionary(spark)
    blocks = files.blocks(spark)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the writer: the only thing that is ordered in one task.
    bases = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _frames(dictionary, name)
        for b in batches:
            for i in range(b.num_rows):
                row = {k: b.column(k)[i].as_py() for k in ("base", "before", "dictionary_hash", "doc_ids", "counts", "ends", "payload")}
                raws = (_wide(read(row["dictionary_hash"], row["payload"][a:z]), width) for a, z in zip([0, *row["ends"]], row["ends"]))
                digests = [(len(x) // 4, zlib.crc32(x)) for x in raws]
                n = np.array([x[0] for x in digests], np.int64)
                if n.tolist() != row["counts"]:
                    raise ValueError("a block's frames don't match its index")
                start = row["base"] + row["before"] + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(n), pa.array([x[1] for x in digests], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(bases, "part").select("base", "before", "dictionary_hash", "doc_ids", "counts", "ends", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, files: TokenFiles, doc_ids: list[int]) -> DataFrame:
    """The ids of a few documents: blocks are skipped by their doc_id range, and only the documents' frames are decompressed."""
    dictionary, name, width = files.dictionary(spark)
    wanted = sorted({int(i) for i in doc_ids})
    schema = "doc_id long, ids array<long>"
    if not wanted:
        return spark.createDataFrame([], schema)
    near = files.blocks(spark).where((F.col("max_doc_id") >= wanted[0]) & (F.col("min_doc_id") <= wanted[-1]))
    index = near.select("dictionary_hash", "payload", F.posexplode("doc_ids").alias("at", "doc_id"), "ends").where(F.col("doc_id").isin(wanted))
    begin = F.when(F.col("at") == 0, 0).otherwise(F.get("ends", F.col("at") - 1))
    frames = index.select("doc_id", "dictionary_hash", F.substring("payload", begin.cast("int") + 1, (F.get("ends", F.col("at")) - begin).cast("int")).alias("frame"))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _frames(dictionary, name)
        for b in batches:
            raws = [np.frombuffer(_wide(read(h, f), width), "<u4").astype(np.int64) for h, f in zip(b.column("dictionary_hash").to_pylist(), b.column("frame").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r.tolist() for r in raws], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return frames.mapInArrow(decode, schema)
