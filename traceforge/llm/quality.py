"""Quality rules by compression bands.

Each whole text, and each fixed 4096-byte chunk of a longer one, is compressed with zstandard.
Text that repeats itself compresses far below prose of its length, encoded or random bytes
compress hardly at all: both fall outside the band that is set for the text's length.

Lengths are told apart by half octaves. ``fit`` sets the least ratio of each from labelled documents of good quality: the
``QUANTILE`` of their ratios less ``MARGIN``, where at least ``LEAST_LABELLED`` of them have that length, and never below the
standing limit of ``BANDS``, which holds everywhere else and without labels. It reads all labelled rows.

Everything but the fit is computed per row inside the scan's own partitions: no shuffle, no state, and a
lost executor only means that its splits run again.

Rows and edge cases: a null text counts as empty; a text without words has zeros everywhere and
fails the base rule; ties with a limit pass; repeated rows are judged each on their own; an empty table gives an
empty result; only ``doc_id`` and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import spent, written
from .textarrays import U, Texts, grams, mix, pieces

#: Whole-text bands by length in bytes: (from this many bytes, least ratio, greatest ratio).
BANDS = (
    (0, 0.42, 1.20),
    (256, 0.38, 0.92),
    (700, 0.33, 0.80),
    (1500, 0.29, 0.72),
    (4000, 0.26, 0.68),
    (10000, 0.23, 0.66),
    (40000, 0.20, 0.64),
)
#: Chunks: their size in bytes, the least size of a last one (a shorter one joins the chunk before), the band, and the share of bad chunks that rejects.
CHUNK, LEAST_CHUNK, CHUNK_BAND, BAD_SHARE = 4096, 1024, (0.22, 0.74), 1 / 3
LEVEL = 3
#: Fitting: how many labelled rows make a length's own limit, the quantile of good ratios, what is taken off it, and into how many cells a ratio of 1 is cut to find it.
LEAST_LABELLED, QUANTILE, MARGIN, CELLS = 50, 0.002, 0.008, 4096
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STARTS = np.array([b[0] for b in BANDS])
_LEAST = np.array([b[1] for b in BANDS])
_MOST = np.array([b[2] for b in BANDS])

#: Least ratio by half octave of the length, where fitted.
Limits = dict[int, float]

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long, reason string"
)


def _per_row(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per word or line) by row."""
    c = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return c[first[1:]] - c[first[:-1]]


def _row_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
    return again[at] == keys


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    """Word, symbol, repeated-line and repeated-window counts of each row."""
    starts, ends, first = t.words()
    n_words = np.diff(first)
    whole = (t.data & 0xC0) != 0x80
    spaces = np.isin(t.data, np.frombuffer(b"\x20\x09\x0a\x0b\x0c\x0d", np.uint8))
    word_chars = t.sums(whole & ~spaces)

    # Lines with a word: a line is a run without \n; it has a word if any byte in it isn't a space.
    lo, hi, lines = t.runs(t.data == 0x0A)
    c = np.concatenate(([0], np.cumsum(~spaces)))
    used = c[hi] > c[lo]
    owner = _row_of(lines)[used]
    salt = mix(np.arange(1, len(t) + 1, dtype=U))
    lo, hi = lo[used], hi[used]
    keys, check = (mix(t.hashes(lo, hi, lane) ^ salt[owner]) for lane in (0, 1))
    order = np.lexsort((check, keys))
    later = np.zeros(len(keys), bool)
    later[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
    n_dup = np.bincount(owner[later], minlength=len(t))

    at, h = grams(t.hashes(starts, ends), first, WINDOW)
    again = at[_twice(mix(h ^ salt[_row_of(first)[at]]))]
    covered = np.zeros(len(starts) + WINDOW, bool)
    for k in range(WINDOW):
        covered[again + k] = True
    n_repeat = _per_row(first, covered[: len(starts)])
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": t.sums(_SYMBOL[t.data]),
        "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": failed,
    }


def half_octave(size: np.ndarray) -> np.ndarray:
    """Twice the binary logarithm of a length, rounded down."""
    return np.floor(2 * np.log2(np.maximum(size, 1)) + 1e-9).astype(np.int64)


def bands(t: Texts, pack: zstandard.ZstdCompressor, limits: Limits) -> dict[str, np.ndarray]:
    """Compression ratios of each row and of its chunks, and the verdict: a reason, or null."""
    n = len(t)
    ratio, chunks, bad, reason = np.ones(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, None, object)
    size = np.diff(t.offsets)
    band = np.searchsorted(_STARTS, size, side="right") - 1
    least = np.maximum(_LEAST[band], [limits.get(int(x), 0.0) for x in half_octave(size)])
    for i in range(n):
        if not size[i]:
            reason[i] = "empty"
            continue
        text = t.text(i)
        ratio[i] = len(pack.compress(text)) / size[i]
        if size[i] > CHUNK:
            cuts = list(range(0, size[i], CHUNK))
            if size[i] - cuts[-1] < LEAST_CHUNK:
                cuts.pop()
            chunks[i] = len(cuts)
            for k, end in zip(cuts, [*cuts[1:], size[i]]):
                bad[i] += not CHUNK_BAND[0] <= len(pack.compress(text[k:end])) / (end - k) <= CHUNK_BAND[1]
        if ratio[i] < least[i]:
            reason[i] = "repetitive"
        elif ratio[i] > _MOST[band[i]]:
            reason[i] = "incompressible"
        elif bad[i] and bad[i] >= BAD_SHARE * chunks[i]:
            reason[i] = "bad chunks"
    return {"ratio": ratio, "n_chunks": chunks, "n_bad_chunks": bad, "reason": reason}


def fit(documents: DataFrame, labels: DataFrame) -> Limits:
    """Least ratios by length from all documents whose label says quality 1 and that pass the base rules.

    Texts are compressed where they are read; doc_id, length and ratio alone meet the labels. The quantile is exact: counts by cells of the ratio
    find the cells that hold its ranks, and only the rows of these are ordered, so no task holds a length's rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            ids = b.column("doc_id")
            for t in pieces(b.column("text")):
                i = np.flatnonzero(~base_counts(t)["base_failed"])
                size = np.diff(t.offsets)[i]
                ratio = np.array([len(pack.compress(t.text(j))) for j in i], float) / np.maximum(size, 1)
                yield pa.RecordBatch.from_arrays([ids.slice(t.first, len(t)).take(pa.array(i)), pa.array(half_octave(size)), pa.array(ratio)], names=["doc_id", "band", "ratio"])

    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    passed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, band long, ratio double")
    rows = written(passed.join(good, "doc_id", "left_semi").select("band", "ratio", F.floor(F.col("ratio") * CELLS).alias("cell")), "quality-ratios")
    limits = {r["band"]: round(r["least"] - MARGIN, 6) for r in _quantiles(rows).collect()}
    spent(rows)
    return limits


def _quantiles(rows: DataFrame) -> DataFrame:
    """Each band's ``QUANTILE`` of its ratios, between neighbours in proportion, where it has ``LEAST_LABELLED`` rows or more."""
    band, at = Window.partitionBy("band"), QUANTILE * (F.col("all") - 1)
    cells = rows.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumns({"upto": F.sum("n").over(band.orderBy("cell")), "all": F.sum("n").over(band)}).where(F.col("all") >= LEAST_LABELLED)
    cells = cells.where((F.col("upto") > F.floor(at)) & (F.col("upto") - F.col("n") <= F.ceil(at))).select("band", "cell", (F.col("upto") - F.col("n")).alias("before"), at.alias("at"))
    near = rows.join(cells, ["band", "cell"]).groupBy("band", "cell", "before", "at", "ratio").agg(F.count(F.lit(1)).alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("band", "cell").orderBy("ratio"))
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
    ends = near.withColumn("upto", upto).groupBy("band", "at").agg(*[F.max(F.when(holds(f("at")), F.col("ratio"))).alias(c) for c, f in (("lo", F.floor), ("hi", F.ceil))])
    return ends.select("band", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("least"))


def _judged(column: pa.Array, limits: Limits) -> Iterator[tuple[Texts, dict[str, np.ndarray]]]:
    pack = zstandard.ZstdCompressor(level=LEVEL)
    for t in pieces(column):
        got = base_counts(t) | bands(t, pack, limits)
        got["kept"] = ~got["base_failed"] & np.array([r is None for r in got["reason"]], bool)
        got["reason"] = np.where(got["base_failed"], "base", got["reason"])
        yield t, got


def quality_report(documents: DataFrame, limits: Limits | None = None) -> DataFrame:
    """One row per document: base counts, compression figures, verdict and its reason."""
    limits = limits or {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for t, got in _judged(b.column("text"), limits):
                long = lambda k: pa.array(got[k], pa.int64())
                flag = lambda k: pa.array(got[k], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(t.first, len(t)), *map(long, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                     flag("base_failed"), flag("kept"), pa.array(got["ratio"]), long("n_chunks"), long("n_bad_chunks"),
                     pa.array(got["reason"].tolist(), pa.string())],
                    names=[f.split()[0] for f in SCHEMA.split(", ")],
                )

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(documents: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows whose text passes, with all their columns, of any name. Null, empty and wordless texts go; repeated rows stay or go alike."""
    limits = limits or {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, got in _judged(b.column("text"), limits):
                yield b.slice(t.first, len(t)).filter(pa.array(got["kept"], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
