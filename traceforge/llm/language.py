"""Language identification by words first, then ever shorter character n-grams.

Learned from labelled texts alone: for each language the frequency of its words, and of the n-grams
(5 down to 1 characters, word ends marked) of those words. A known word scores its log frequency in
each language; an unseen one the mean of its longest known n-grams; a word of unknown characters
says nothing. A text goes to the language of the greatest sum over all its words; ``score`` is that
language's share of the softmax.

Fitting reads about ``TRAIN_ROWS`` different labelled rows of each language at most, drawn by a hash of doc_id and text, so a
rare language is learned as well as a frequent one, and many texts under one doc_id are texts of their own (equal rows count once); it keeps every word and n-gram seen ``LEAST`` times in
them (a word seen once tells no more than its n-grams). So the rows bound the model, which is broadcast. Counting
is a Spark aggregation that combines inside tasks. Prediction needs no shuffle and reads whole texts.

Rows and edge cases: a word is a run of letters with their marks (fractions, powers and circled numbers are none); a
null text, or one without letters, is ``und`` with score 0, as is everything if no labelled row exists; ties go to the
first language in code point order; null labels and doc_ids are not learned from; a very long text or word is scored
whole, in stretches; repeated rows are judged each; only doc_id, text and lang are read, so other columns never clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import spent, written

#: Labelled rows of a language, and how often a word or n-gram must stand in them.
TRAIN_ROWS, LEAST = 5_000, 2
LONGEST, ADD = 5, 0.1
#: Words whose scores a worker remembers; longer words than this many letters are scored anew.
KEEP, KEEP_LETTERS = 300_000, 40
#: N-grams of a word that are looked up at a time.
STRETCH = 1 << 16
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_logs: np.ndarray
    gram_logs: np.ndarray
    _seen: dict[str, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None

    def score(self, word: str) -> np.ndarray:
        """The word's log score in each language."""
        at = self.words.get(word)
        if at is not None:
            return self.word_logs[at]
        marked, get = f"<{word}>", self.grams.get
        for n in range(min(LONGEST, len(marked)), 0, -1):
            total, found = 0.0, 0
            for k in range(0, len(marked) - n + 1, STRETCH):
                known = [i for j in range(k, min(k + STRETCH, len(marked) - n + 1)) if (i := get(marked[j : j + n])) is not None]
                if known:
                    total, found = total + np.add.reduce(self.gram_logs[known], axis=0), found + len(known)
            if found:
                return total / found
        return np.zeros(len(self.languages))

    def _row(self, word: str) -> int:
        """The place of a word's scores among the remembered ones."""
        at = self._seen.get(word)
        if at is None:
            at = self._seen[word] = len(self._seen)
            if self._scores is None or at >= len(self._scores):
                grown = np.zeros((max(1024, 2 * at), len(self.languages)))
                grown[:at] = self._scores[:at] if self._scores is not None else 0
                self._scores = grown
            self._scores[at] = self.score(word)
        return at

    def _afresh(self, found: list[str]) -> list[int]:
        """Forget all words but these."""
        self._seen, self._scores = {}, None
        return [self._row(w) for w in found]

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text)
        if not found or not self.languages:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.languages))
        for k in range(0, len(found), KEEP):
            some = found[k : k + KEEP]
            rows = list(map(self._seen.get, some))
            if None in rows:
                long = [w for w in some if len(w) > KEEP_LETTERS]
                if long:
                    some = [w for w in some if len(w) <= KEEP_LETTERS]
                    rows = list(map(self._seen.get, some))
                    total += sum(map(self.score, long))
                rows = [self._row(w) if i is None else i for w, i in zip(some, rows)] if len(self._seen) + len(some) <= KEEP else self._afresh(some)
            if rows:
                total += self._scores[rows].sum(axis=0)
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _counted(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) of labelled texts, combined by batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                counts.setdefault(lang, Counter()).update(words(text))
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            langs, ws, ns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ws, pa.string()), pa.array(ns, pa.int64())], names=["lang", "word", "n"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _gram_counts(counts: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: Counter = Counter()
            for lang, w, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n"))):
                for size in range(1, LONGEST + 1):
                    for g in grams(w, size):
                        got[lang, g] += n
            langs, gs = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(gs, pa.string()), pa.array(list(got.values()), pa.int64())], names=["lang", "word", "n"])

    return counts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _table(counts: DataFrame, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Words of at least LEAST occurrences with their log frequencies by language."""
    often = counts.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("lang", "n")).alias("by")).where(F.col("n") >= LEAST)
    got = often.select("word", F.explode("by").alias("b")).select("word", "b.lang", "b.n").toArrow()
    by_word = got["word"].combine_chunks().dictionary_encode()
    names = by_word.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    at = {lang: i for i, lang in enumerate(languages)}
    table = np.zeros((len(names), len(languages)))
    table[place[by_word.indices.to_numpy()], [at[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    totals = table.sum(axis=0)
    logs = np.log((table + ADD) / (totals + ADD * max(1, len(names))))
    return {names[i]: k for k, i in enumerate(order)}, logs.astype(np.float32)


def fit(documents: DataFrame) -> Model:
    """A model from rows with a lang that are not held out."""
    labelled = documents.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    # By id and text, so that many texts under one id are told apart; equal rows are one. A row per language reaches the driver.
    hashed = labelled.withColumn("_hash", F.xxhash64("doc_id", "text"))
    sizes = {r["lang"]: max(1, r["n"]) for r in hashed.groupBy("lang").agg(F.approx_count_distinct("_hash").alias("n")).collect()}
    if not sizes:
        return Model([], {}, {}, np.zeros((0, 0)), np.zeros((0, 0)))
    rows = F.create_map(*[F.lit(x) for kv in sorted(sizes.items()) for x in kv])
    # Only what is drawn travels, to leave out rows that are drawn twice.
    drawn = hashed.where(F.pmod("_hash", F.element_at(rows, F.col("lang"))) < TRAIN_ROWS).dropDuplicates(["lang", "_hash"])
    counts = written(_counted(drawn), "word-counts")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    ws, word_logs = _table(counts, languages)
    gs, gram_logs = _table(_gram_counts(counts), languages)
    spent(counts)
    return Model(languages, ws, gs, word_logs, gram_logs)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column("text")]
            langs, scores = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
