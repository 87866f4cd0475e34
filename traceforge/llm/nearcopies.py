"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct shingles (k consecutive lower-cased words). Under each of
``PERMUTATIONS`` hash functions both the least and the greatest value are kept, so one evaluation
gives two unbiased signature values. ``BANDS`` bands of ``ROWS`` values make bucket keys: two sets
of similarity s share a bucket with probability 1 - (1 - s**6)**44, which misses 2 in a million pairs at 0.8.

Work goes from cheap to dear, and never lists all pairs of a group:

1. Documents with the same set (by a 128-bit digest) are one class; only its least doc_id goes on.
2. Each class is compared with one other: the least member of the bucket leaders it shares most buckets
   with. Confirmed links make provisional components.
3. Only pairs of a bucket that still lie in different components are looked at again; most fall to
   exact bounds on the overlap (set sizes; the set bits that differ between 2048-bit maps), the rest
   are compared in full. A component of over ``BLOCK`` members of a bucket has blocks of its own, which meet
   only blocks of other components; all smaller ones of the bucket share blocks. So a large component beside a
   few strangers costs its size times theirs, and block pairs spread over tasks. No pair of a bucket is left
   out, unless its two documents are already known to be in one component. What stays quadratic is a bucket
   with many members of large components that don't link: all those pairs must be looked at.

A link is confirmed on the full sets of both texts, with shingles numbered by their very words, not hashed.
Keys of every join are ids or hashes with one row per key on one side, so Spark can split a hot side.

Rows and edge cases: a text with fewer words than k is one shingle, its whole sequence; a null text
or one without words has an empty set and links to nothing; rows that share a doc_id count as one
document, linked by any of its texts; a null doc_id is never linked and is kept; repeated rows are reported each, with one
component; an empty table gives an empty result; only doc_id and text are read by the report.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import fresh, spent, written
from .textarrays import STEP, U, Texts, grams, mix, pieces, renamed, sequence_hashes, starts_of

PERMUTATIONS, ROWS, BANDS = 132, 6, 44
MAP_BITS, BLOCK, PAIR_BYTES = 2048, 256, 4 << 20

_A = mix(np.arange(1, PERMUTATIONS + 1, dtype=U)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1001, PERMUTATIONS + 1001, dtype=U)).astype(np.uint32) | np.uint32(1)
_C = mix(np.arange(2001, ROWS + 2001, dtype=U)) | U(1)
SIGNATURE = "doc_id long, n long, d0 long, d1 long, bands array<long>"


def shingle_sets(t: Texts, k: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, in ascending order."""
    low = t.lowered()
    starts, ends, first = low.words()
    words = low.hashes(starts, ends)
    at, h = grams(words, first, k)
    owner = np.repeat(np.arange(len(t)), np.diff(first))
    cut = np.searchsorted(owner[at], np.arange(len(t) + 1))
    n = np.diff(first)
    out = []
    for i in range(len(t)):
        if cut[i + 1] > cut[i]:
            out.append(np.unique(h[cut[i] : cut[i + 1]]))
        elif n[i]:  # fewer words than k: the sequence itself, apart from any k-shingle
            out.append(mix(sequence_hashes(words[first[i] : first[i + 1]], int(n[i])) ^ U(n[i])))
        else:
            out.append(np.zeros(0, U))
    return out


def linked(t: Texts, k: int, percent: int) -> np.ndarray:
    """Whether rows 2i and 2i + 1 have 100 * intersection >= percent * union; on words, not hashes."""
    low = t.lowered()
    starts, ends, first = low.words()
    words, n = low.codes(starts, ends), np.diff(first)
    at = starts_of(first, len(words), k)
    shingles = sequence_hashes(words, k, renamed)[at] if len(at) else at
    row = np.repeat(np.arange(len(t)), n)[at]
    most = shingles.max(initial=0) + 1
    own = np.unique(row * most + shingles)  # the distinct ones of each row
    row, shingles = own // most, own % most
    size = np.bincount(row, minlength=len(t))
    pair = np.sort(row // 2 * most + shingles)
    both = np.bincount(pair[1:][pair[1:] == pair[:-1]] // most, minlength=len(t) // 2)
    out = (100 * both >= percent * (size[::2] + size[1::2] - both)) & (size[::2] > 0) & (size[1::2] > 0)
    for i in np.flatnonzero((n[::2] < k) & (n[::2] == n[1::2]) & (n[::2] > 0)):
        x, y = words[first[2 * i] : first[2 * i + 1]], words[first[2 * i + 1] : first[2 * i + 2]]
        out[i] = (x == y).all()
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys of non-empty sets, one row each."""
    size = np.array([len(s) for s in sets])
    begin = np.cumsum(size) - size
    flat = np.concatenate(sets)
    low, high = flat.astype(np.uint32), (flat >> U(32)).astype(np.uint32)
    values = np.empty((len(sets), 2 * PERMUTATIONS), np.uint32)
    x, y = np.empty_like(low), np.empty_like(low)
    for i in range(PERMUTATIONS):
        np.multiply(low, _A[i], out=x)
        np.multiply(high, _B[i], out=y)
        np.add(x, y, out=x)
        values[:, 2 * i] = np.minimum.reduceat(x, begin)
        values[:, 2 * i + 1] = np.maximum.reduceat(x, begin)
    grouped = mix(values.astype(U).reshape(len(sets), BANDS, ROWS) + U(1)) * _C
    return mix(grouped.sum(axis=2, dtype=U) + mix(np.arange(BANDS, dtype=U)))


def _signed(documents: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for t in pieces(b.column("text")):
                sets = shingle_sets(t, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands = np.zeros((len(sets), BANDS), U)
                if full:
                    bands[full] = signatures([sets[i] for i in full])
                digest = np.array([(mix(s).sum(), mix(s ^ STEP).sum()) for s in sets], U).view(np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(t.first, len(t)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists], names=["doc_id", "n", "d0", "d1", "bands"])

    return documents.select("doc_id", "text").mapInArrow(run, SIGNATURE)


def bit_map(s: np.ndarray) -> np.ndarray:
    """The set's elements as bits of a map of MAP_BITS."""
    m = np.zeros(MAP_BITS, np.uint8)
    m[(s % U(MAP_BITS)).astype(np.int64)] = 1
    return np.packbits(m).view(U)


def _with_maps(texts: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in pieces(b.column("text")):
                sets = shingle_sets(t, k)
                rows = b.slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([bit_map(s).tobytes() for s in sets], pa.binary()), rows.column("text")], names=["id", "n", "map", "text"])

    return texts.mapInArrow(run, "id long, n long, map binary, text string")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    side = lambda id_, text: texts.select(F.col("id").alias(id_), F.col("text").alias(text))
    with_texts = pairs.select("a", "b").join(side("a", "text_a"), "a").join(side("b", "text_b"), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Rows 2i and 2i + 1 are the texts of pair i; pieces end at any row, so an odd one waits for its partner.
            order = pa.array(np.arange(2 * b.num_rows).reshape(2, -1).T.ravel())
            both = pa.concat_arrays([b.column(c).cast(pa.large_string()) for c in ("text_a", "text_b")]).take(order)
            at = 0
            while at < b.num_rows:
                size, end = 0, at
                while end < b.num_rows and (end == at or size < PAIR_BYTES):
                    size += sum(len(both[2 * end + x].as_buffer() or b"") for x in (0, 1))
                    end += 1
                (t,) = pieces(both.slice(2 * at, 2 * (end - at)), 1 << 62)
                yield b.select(["a", "b"]).slice(at, end - at).filter(pa.array(linked(t, k, percent)))
                at = end

    return with_texts.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _blocks(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of mixed buckets by block, and the pairs of blocks that hold different components.

    ``placed`` has key, id and component. Blocks: (key, part, block, id, component); pairs: (pair, key, part_1, block_1,
    part_2, block_2). A part is a component of over ``BLOCK`` members of its bucket, or "rest", all the others.
    """
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    of_part = F.when(F.col("n") > BLOCK, F.col("component").cast("string")).otherwise("rest")
    sizes = written(sizes.join(mixed, "key", "left_semi").withColumn("part", of_part), "sizes")
    parts = sizes.groupBy("key", "part").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("blocks"), F.count(F.lit(1)).alias("components"))
    one, two = (parts.select("key", *[F.col(c).alias(f"{c}_{i}") for c in ("part", "blocks", "components")]) for i in (1, 2))
    pairs = (
        one.join(two, "key").where("part_1 < part_2 OR (part_1 = part_2 AND part_1 = 'rest' AND components_1 > 1)")
        .withColumn("block_1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_1") - 1)))
        .withColumn("block_2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_2") - 1)))
        .where("part_1 < part_2 OR block_1 <= block_2")
        .select(F.monotonically_increasing_id().alias("pair"), "key", "part_1", "block_1", "part_2", "block_2")
    )
    members = placed.join(sizes.select("key", "component", "part"), ["key", "component"]).join(parts.select("key", "part", "blocks"), ["key", "part"])
    blocks = members.select("key", "part", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", "component")
    # The pairs are written before anything reads them, as their numbers hold only then.
    out = written(blocks, "blocks"), written(pairs, "block-pairs")
    spent(sizes)
    return out


def _open_pairs(blocks: DataFrame, pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Pairs of documents (a, b) of block pairs, in different components, that sizes and bit maps do not rule out."""
    rows = blocks.join(maps, "id")
    keys = lambda i: pairs.select("pair", "key", F.col(f"part_{i}").alias("part"), F.col(f"block_{i}").alias("block"), F.expr("part_1 = part_2 AND block_1 = block_2").alias("alone"))
    left = rows.join(keys(1), ["key", "part", "block"]).withColumn("side", F.when(F.col("alone"), 2).otherwise(0))
    right = rows.join(keys(2).where("NOT alone"), ["key", "part", "block"]).withColumn("side", F.lit(1))
    sides = left.unionByName(right).select("pair", "side", "id", "component", "n", "map")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table) -> pa.RecordBatch:
            ids, comp, n, side = (t[c].to_numpy() for c in ("id", "component", "n", "side"))
            maps = np.frombuffer(b"".join(t["map"].to_pylist()), U).reshape(len(ids), -1)
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            out = []
            for x in left:
                y = right[(comp[right] != comp[x]) & ((ids[right] > ids[x]) | (side[right] == 1))]
                total = n[y] + n[x]
                # Elements not shared are at least the bits that differ: 2 * overlap <= total - bits.
                most = (total - np.bitwise_count(maps[y] ^ maps[x]).sum(axis=1)) // 2
                most = np.minimum(most, np.minimum(n[y], n[x]))
                out += [(min(ids[x], z), max(ids[x], z)) for z in ids[y[100 * most >= percent * (total - most)]]]
            a, b = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        # Rows arrive sorted by pair; one may span batches.
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            of = b.column("pair").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if held and of[x] != now:
                    yield found(pa.Table.from_batches(held))
                    held = []
                now = of[x]
                held.append(b.slice(x, y - x))
        if held:
            yield found(pa.Table.from_batches(held))

    return sides.repartition("pair").sortWithinPartitions("pair").mapInArrow(run, "a long, b long").distinct()


def _repeats(signed: DataFrame) -> bool:
    """Whether a doc_id has several rows."""
    return not signed.groupBy("doc_id").count().where("count > 1").isEmpty()


def _near_copies(documents: DataFrame, k: int, percent: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """The report, and the two tables that it reads."""
    documents = documents.select("doc_id", "text")
    signed = written(_signed(documents, k), "signatures")
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(some.groupBy("d0", "d1").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "classes")

    buckets = classes.select("id", F.explode("bands").alias("key"))
    leaders = written(buckets.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1"), "leaders")
    members = written(buckets.join(leaders, "key").select("key", "id", "leader"), "members")
    spent(leaders)
    # Every text of an id once: repeated rows tell nothing more.
    once = documents.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]) if _repeats(some) else documents
    texts = written(_with_maps(once.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id").select(F.col("doc_id").alias("id"), "text"), k), "texts")

    shared = members.where("id <> leader").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("times"))
    first = shared.groupBy("id").agg(F.max(F.struct("times", (-F.col("leader")).alias("least"))).alias("best"))
    links = written(confirmed(first.select((-F.col("best.least")).alias("a"), F.col("id").alias("b")), texts, k, percent), "links")
    provisional = components(links)

    # A bucket of one component needs no second look.
    placed = written(members.join(provisional, members["id"] == provisional["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component")), "placed")
    spent(members, provisional)
    blocks, pairs = _blocks(placed)
    spent(placed)
    open_ = written(_open_pairs(blocks, pairs, texts.select("id", "n", "map"), percent), "open")
    spent(blocks, pairs)
    more = written(confirmed(open_, texts, k, percent), "links")
    spent(open_, texts)
    named = components(links.unionByName(more))
    spent(links, more)
    of_class = written(
        classes.join(named, classes["id"] == named["node"], "left").select("d0", "d1", F.coalesce("component", "id").alias("component_id")), "components"
    )
    spent(classes, named)
    placed_docs = signed.select("doc_id", "n", "d0", "d1").join(of_class, ["d0", "d1"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    report = placed_docs.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    return report, (signed, of_class)


def near_copies(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id it is linked to, by any path), kept."""
    return _near_copies(documents, k, percent)[0]


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` that are the least doc_id of their component, with all their columns, of any name.

    A document without words (null, empty) is its own component and stays, as does a null doc_id; repeated rows of a
    doc_id that stays all stay.
    """
    report, tables = _near_copies(documents, k, percent)
    key = fresh(documents.columns, "gone")
    gone = written(report.where("NOT kept").select(F.col("doc_id").alias(key)).distinct(), "gone")
    spent(*tables)
    return documents.join(gone, documents["doc_id"] == gone[key], "left_anti").select(*documents.columns)
