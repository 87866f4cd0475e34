"""Substring dedup by level-wise doubling: windows repeated at half the length alone are extended to the whole.

A window is ``window`` consecutive words of one document. A word goes if a window covers it whose
words also start earlier: in a document of smaller doc_id, or before in the same one.

First length (half a window). Of each window the least-hashed half-length gram is its anchor, the
same wherever the window stands; neighbouring windows share anchors, so a document has about one *run*
of windows per anchor. A run's row is (anchor hash, hash of all its words, doc_id, first and last
window). Runs with equal words are copies of the earliest: all their windows go at once. An anchor
that occurs once, or always in the same words, has nothing more to tell.

Second length. Where one anchor stands in different words, the earliest run of each kind is extended:
its windows are hashed in full, 128 bits wide, and all but the first occurrence of each go. Nothing
survives to a third length, as a word goes by whole windows only.

Scale and skew: runs of the same words meet first inside a task's chunk, which passes on one row;
an anchor that stands in over ``HOT_SHARE`` of a sample of documents (a passage that a third of them quote)
goes to the second length at once, whose counts combine before the shuffle and whose join Spark may
split; so the rows that meet by one anchor are some of that share, in a window that spills. Texts travel
zstandard-compressed. Nothing is capped: the sample only chooses a path, both are exact. The hot anchors are at
most the sample's runs over ``HOT_SHARE * HOT_SAMPLE``, some ten thousand hashes.

Windows are told apart by 128 bits of non-linear hashes of their words.

Rows and edge cases: a null text has no words; texts shorter than a window lose nothing; equal rows
count as one document and fare alike; so do different texts under one doc_id (versions), each of which loses what
starts earlier elsewhere or in any version; ties at the same doc_id and start are no repeats. A null
doc_id has no place in the order: such a row neither loses words nor makes others lose them. An empty table
gives an empty result. The stage keeps all columns, of any name, and every row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import fresh, spent, written
from .textarrays import U, Texts, joined, mix, pieces, sequence_hashes, starts_of

CHUNK_BYTES = 4 << 20
#: Documents looked at for frequent anchors, and the share of them that makes an anchor hot.
HOT_SAMPLE, HOT_SHARE = 4000, 0.005
GONE, RUN, WINDOW = 0, 1, 2
ROW = "kind int, h long, sig long, doc_id long, version long, lo long, hi long"


def doubled(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all half windows, and of all windows by joining two halves."""
    k = window // 2
    half = sequence_hashes(words, k)
    if len(words) < window:
        return half, words[:0]
    return half, joined(half[: len(half) - k], half[k:]) if window == 2 * k else sequence_hashes(words, window)


def window_hashes(t: Texts, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Half-window hashes, both lanes of window hashes, and each row's first word."""
    starts, ends, first = t.words()
    half, d0 = doubled(t.hashes(starts, ends), window)
    return half, d0, doubled(t.hashes(starts, ends, 1), window)[1], first


def runs(t: Texts, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor hash, hash of the run's words, row, first and last window in the row; and both lanes of window hashes with each row's first word."""
    gram, d0, d1, first = window_hashes(t, window)
    k, n = window // 2, first[-1]
    at = starts_of(first, n, window)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none.astype(U), none.astype(U), none, none, none, d0, d1, first
    # The least gram of each window, the first of equals: one pass per offset, on flat arrays.
    size = n - window + 1
    least, offset = gram[:size].copy(), np.zeros(size, np.int32)
    for j in range(1, window - k + 1):
        lower = gram[j : j + size] < least
        np.copyto(least, gram[j : j + size], where=lower)
        offset[lower] = j
    anchor = at + offset[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    i = np.flatnonzero(new)
    lo, hi = at[i], at[np.append(i[1:], len(at)) - 1]
    row = np.searchsorted(first, lo, side="right") - 1
    # First and last window hold all of a run's words, as they all hold its anchor.
    sig = joined(d0[lo], d0[hi]) ^ mix(joined(d1[lo], d1[hi]) + (hi - lo).astype(U))
    return gram[anchor[i]], sig, row, lo - first[row], hi - first[row], d0, d1, first


def _rows(kind: int, h, sig, doc, version, lo, hi) -> pa.RecordBatch:
    n = len(doc)
    long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64) if n else np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), long(h), long(sig), long(doc), long(version), long(lo), long(hi)], names=[f.split()[0] for f in ROW.split(", ")])


def _earliest(h: np.ndarray, sig: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which rows are the first occurrence (least doc, then place) of their (h, sig); equal occurrences all are."""
    order = np.lexsort((lo, doc, sig, h))
    a, b, c, d = h[order], sig[order], doc[order], lo[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.zeros(len(order), bool)
    out[order] = (c == c[head]) & (d == d[head])
    return out


def _united(doc: np.ndarray, version: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Touching ranges of one text made one."""
    order = np.lexsort((lo, version, doc))
    doc, version, lo, hi = doc[order], version[order], lo[order], hi[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (lo[1:] > hi[:-1] + 1)
    i = np.flatnonzero(new)
    return doc[i], version[i], lo[i], np.maximum.reduceat(hi, i) if len(i) else hi


def _windows(lo: np.ndarray, hi: np.ndarray, base: np.ndarray, d0: np.ndarray, d1: np.ndarray) -> tuple[np.ndarray, ...]:
    """All windows of some runs: index of the run, 128-bit hash, start."""
    size = hi - lo + 1
    run = np.repeat(np.arange(len(lo)), size)
    start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[run]
    at = start + base[run]
    return run, d0[at], d1[at], start


def _first_length(documents: DataFrame, window: int, hot: np.ndarray) -> DataFrame:
    """Rows of runs, of the windows of hot anchors, and of what a chunk can tell to be gone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.filter(pa.compute.is_valid(b.column("doc_id"))) if b.column("doc_id").null_count else b
            ids, versions = known.column("doc_id").to_numpy(), known.column("version").to_numpy()
            for t in pieces(known.column("text"), CHUNK_BYTES):
                h, sig, row, lo, hi, d0, d1, first = runs(t, window)
                doc, version = ids[t.first + row], versions[t.first + row]
                is_hot = np.isin(h, hot)
                i = np.flatnonzero(~is_hot)
                early = _earliest(h[i], sig[i], doc[i], lo[i])
                keep, drop = i[early], i[~early]
                yield _rows(RUN, h[keep], sig[keep], doc[keep], version[keep], lo[keep], hi[keep])
                gone = [(doc[drop], version[drop], lo[drop], hi[drop])]
                if is_hot.any():
                    j = np.flatnonzero(is_hot)
                    of, x, y, start = _windows(lo[j], hi[j], first[row[j]], d0, d1)
                    wdoc, wversion = doc[j][of], version[j][of]
                    early = _earliest(x, y, wdoc, start)
                    yield _rows(WINDOW, x[early], y[early], wdoc[early], wversion[early], start[early], start[early])
                    gone.append((wdoc[~early], wversion[~early], start[~early], start[~early]))
                d, v, a, z = _united(*(np.concatenate(x) for x in zip(*gone)))
                # Their own place in the exchange: anywhere, evenly.
                yield _rows(GONE, mix(joined(d.astype(U), a.astype(U))), np.zeros(len(d), np.int64), d, v, a, z)

    return documents.mapInArrow(run, ROW)


def hot_anchors(documents: DataFrame, window: int) -> np.ndarray:
    """Anchors in HOT_SHARE of a sample of about HOT_SAMPLE documents, or more."""
    every = max(1, documents.count() // HOT_SAMPLE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in pieces(b.column("text")):
                h, _, row, *_ = runs(t, window)
                pairs = np.unique(np.stack([row.astype(U), h]), axis=1) if len(h) else np.zeros((2, 0), U)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64))], names=["h"])

    drawn = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    counts = drawn.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= int(HOT_SHARE * HOT_SAMPLE))
    return np.sort(np.array([r["h"] for r in counts.select("h").collect()], np.int64).view(U))


def with_versions(documents: DataFrame) -> DataFrame:
    """doc_id, text and version: 0, but a hash of the text where a doc_id has several texts."""
    d = documents.select("doc_id", "text")
    h = F.xxhash64("text")
    shared = d.groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("doc_id IS NOT NULL AND lo <> hi").select("doc_id", F.lit(True).alias("many"))
    shared = written(shared, "versions")
    if shared.isEmpty():
        return d.withColumn("version", F.lit(0).cast("long"))
    return d.join(shared, "doc_id", "left").select("doc_id", "text", F.when(F.col("many"), h).otherwise(0).alias("version"))


def _packed(documents: DataFrame) -> DataFrame:
    """(doc_id, version, compressed text): what travels to a join."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        for b in batches:
            for t in pieces(b.column("text")):
                z = [pack.compress(t.text(i)) for i in range(len(t))]
                own = b.slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("version"), pa.array(z, pa.binary())], names=["doc_id", "version", "z"])

    return documents.mapInArrow(run, "doc_id long, version long, z binary")


def _second_length(packed_with_runs: DataFrame, window: int) -> DataFrame:
    """The windows of each text's open ranges."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for doc, version, z, lo, hi in zip(*(b.column(c).to_pylist() for c in ("doc_id", "version", "z", "lo", "hi"))):
                (t,) = pieces(pa.array([unpack.decompress(z).decode()], pa.large_string()), 1 << 62)
                _, d0, d1, _ = window_hashes(t, window)
                lo, hi = np.array(lo, np.int64), np.array(hi, np.int64)
                _, x, y, start = _windows(lo, hi, np.zeros(len(lo), np.int64), d0, d1)
                yield _rows(WINDOW, x, y, np.full(len(start), doc, np.int64), np.full(len(start), version, np.int64), start, start)

    return packed_with_runs.mapInArrow(run, ROW)


def repeated_ranges(documents: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, version, ranges): per text of ``with_versions`` that loses words, the ranges (lo, hi) of window starts that also start earlier."""
    first = _first_length(documents, window, hot_anchors(documents, window))
    by_kind, by_anchor = Window.partitionBy("h", "sig").orderBy("doc_id", "lo"), Window.partitionBy("h")
    judged = first.select("*", F.rank().over(by_kind).alias("place"), F.min(F.when(F.col("kind") == RUN, F.col("sig"))).over(by_anchor).alias("s0"), F.max(F.when(F.col("kind") == RUN, F.col("sig"))).over(by_anchor).alias("s1"))
    verdict = F.when(F.col("kind") != RUN, F.col("kind")).when(F.col("place") > 1, GONE).when(F.col("s0") != F.col("s1"), RUN)
    rows = written(judged.withColumn("kind", verdict).where("kind IS NOT NULL").select("kind", *[F.when(F.col("kind") == WINDOW, F.col(c)).alias(c) for c in ("h", "sig")], "doc_id", "version", "lo", "hi"), "runs")

    key = ["doc_id", "version"]
    open_ = rows.where(F.col("kind") == RUN).groupBy(*key).agg(F.collect_set(F.struct("lo", "hi")).alias("r")).select(*key, F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
    extended = _second_length(_packed(documents).join(open_, key), window)
    columns = ["h", "sig", "doc_id", "version", "lo"]
    windows = written(extended.unionByName(rows.where(F.col("kind") == WINDOW)).select(*columns), "windows")
    starts = written(windows.groupBy("h", "sig").agg(F.min(F.struct("doc_id", "lo")).alias("first"), F.max(F.struct("doc_id", "lo")).alias("last")).where("first <> last").select("h", "sig", "first"), "starts")
    again = windows.join(starts, ["h", "sig"]).where(F.struct("doc_id", "lo") != F.col("first"))
    ranges = rows.where(F.col("kind") == GONE).select(*key, "lo", "hi").unionByName(again.select(*key, "lo", F.col("lo").alias("hi")))
    out = written(ranges.groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges")
    spent(rows, windows, starts)
    return out


def _covered(ranges: Iterable[dict] | None, n: int, window: int) -> np.ndarray:
    """Which of n words the windows of some ranges cover."""
    change = np.zeros(n + 1, np.int64)
    for r in ranges or ():
        change[min(r["lo"], n)] += 1
        change[min(r["hi"] + window, n)] -= 1
    return np.cumsum(change[:n]) > 0


def _kept(words: list[bytes], ranges: Iterable[dict], window: int) -> list[bytes]:
    return [w for w, gone in zip(words, _covered(ranges, len(words), window).tolist()) if not gone]


def repeat_report(documents: DataFrame, window: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for z, ranges in zip(b.column("z"), b.column("ranges")):
                words = unpack.decompress(z.as_py()).split()
                n, ranges = len(words), ranges.as_py()
                if ranges:
                    words = _kept(words, ranges, window)
                out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            n, gone, sha = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    d = with_versions(documents)
    return _packed(d).join(repeated_ranges(d, window), ["doc_id", "version"], "left").mapInArrow(run, schema)


def without_repeats(documents: DataFrame, window: int = 20) -> DataFrame:
    """The rows of ``documents``; a text that lost words becomes its kept words joined by one space, and n_chars, if there, its length.

    Null and empty texts stay as they are, as does a row with a null doc_id; a text whose words all go becomes empty.
    """
    d = with_versions(documents)
    ranges = repeated_ranges(d, window)
    doc, version, found = (fresh(documents.columns, c) for c in ("of_doc", "of_version", "ranges_gone"))
    ranges = ranges.select(F.col("doc_id").alias(doc), F.col("version").alias(version), F.col("ranges").alias(found))
    same = (documents["doc_id"] == ranges[doc]) & ((ranges[version] == 0) | (F.xxhash64(documents["text"]) == ranges[version]))
    names, schema = documents.columns, documents.schema
    with_ranges = documents.join(ranges, same, "left").select(*names, found)
    at, size_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes = [], []
            for text, ranges in zip(b.column(at).to_pylist(), b.column(len(names))):
                ranges = ranges.as_py()
                if ranges and text is not None:
                    text = b" ".join(_kept(text.encode().split(), ranges, window)).decode()
                texts.append(text)
                sizes.append(len(text) if ranges and text is not None else None)
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            if size_at is not None:
                columns[size_at] = pa.compute.coalesce(pa.array(sizes, columns[size_at].type), columns[size_at])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return with_ranges.mapInArrow(run, schema)
