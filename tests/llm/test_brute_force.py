"""Operators and stages against plain versions on small tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

import corpus_pipeline
from traceforge.llm import textarrays, extraction, labelledpages, language, media, mixing, nearcopies, packing, quality, queries, repeats, tokenfiles, wordids
from traceforge.llm.packing import Limits, Packer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return docs.toPandas().sort_values("doc_id")


def ids_of(text):
    t = wordids.worker(wordids.tokenizer_path()).tokenizer
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_quality_counts(spark, sf, local):
    got = queries.op6_quality(spark, sf).toPandas().set_index("doc_id")
    pack = zstandard.ZstdCompressor(level=quality.LEVEL)
    limits = plain_limits(local, spark.read.parquet(f"{sf}/labels.parquet").toPandas())
    for d in local.itertuples():
        ws = WORDS.findall(d.text)
        tri = Counter(zip(ws, ws[1:], ws[2:]))
        cover = set()
        for i in range(len(ws) - 2):
            if tri[tuple(ws[i : i + 3])] > 1:
                cover |= {i, i + 1, i + 2}
        lines, seen, dup = d.text.split("\n"), set(), 0
        for x in lines:
            dup += bool(WORDS.search(x)) and x in seen
            seen.add(x)
        r = got.loc[d.doc_id]
        want = (len(ws), sum(map(len, ws)), sum(d.text.count(c) for c in "#*$%&|<>"), dup, len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = len(ws) < 50 or 100 * len(cover) > 50 * len(ws)
        assert r.base_failed == failed and not (failed and r.kept)
        raw = d.text.encode()
        assert r.ratio == pytest.approx(len(pack.compress(raw)) / len(raw))
        assert r.kept == (not failed and plain_verdict(raw, limits)), d.doc_id


def plain_ratio(raw):
    return len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(raw)) / len(raw)


def plain_verdict(raw, limits):
    """Whether a text's ratio, and those of enough of its chunks, lie in their bands."""
    _, least, most = [b for b in quality.BANDS if b[0] <= len(raw)][-1]
    least = max(least, limits.get(math.floor(2 * math.log2(len(raw))), 0))
    chunks = [raw[k : k + 4096] for k in range(0, len(raw), 4096)] if len(raw) > 4096 else []
    if chunks and len(chunks[-1]) < 1024:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    bad = sum(not 0.22 <= plain_ratio(c) <= 0.74 for c in chunks)
    return least <= plain_ratio(raw) <= most and (bad == 0 or 3 * bad < len(chunks))


def plain_limits(local, labels):
    good, ratios = set(labels[labels["quality"] == 1]["doc_id"]), defaultdict(list)
    for d in local.itertuples():
        ws = WORDS.findall(d.text)
        tri = Counter(zip(ws, ws[1:], ws[2:]))
        cover = {i + j for i in range(len(ws) - 2) if tri[tuple(ws[i : i + 3])] > 1 for j in range(3)}
        if d.doc_id in good and len(ws) >= 50 and 100 * len(cover) <= 50 * len(ws):
            raw = d.text.encode()
            ratios[math.floor(2 * math.log2(len(raw)))].append(plain_ratio(raw))
    return {k: round(float(np.quantile(v, quality.QUANTILE)) - quality.MARGIN, 6) for k, v in ratios.items() if len(v) >= quality.LEAST_LABELLED}


def test_fitted_bands_reject_poor_text_and_keep_good(spark):
    """At a tenth of the bench's scale: limits by length from labels, against plain ones; good documents stay, poor ones go."""
    at = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "labels"))
    want = plain_limits(docs.toPandas(), labels.toPandas())
    got = quality.fit(docs, labels)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    some = quality.fit(docs, labels) | {20: 0.46, 21: 0.45, 22: 0.44, 23: 0.43, 24: 0.42}
    judged = quality.quality_report(docs, some).where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg({"kept": "count"}).collect()
    assert {r["quality"] for r in judged} == {0, 1}


THUE_MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
OTHER_WAY = THUE_MORSE.translate(str.maketrans("ab", "ba"))


def test_words_that_cancel_in_polynomials_differ(spark):
    """Two words whose polynomial hashes agree modulo 2**64 for every odd base."""
    tail = [" ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))]
    rows = [(1, f"{THUE_MORSE} {tail[0]}"), (2, f"{OTHER_WAY} {tail[0]}"), (3, f"{THUE_MORSE}\n{OTHER_WAY}"), (4, THUE_MORSE), (5, OTHER_WAY)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {r["doc_id"]: r["n_removed"] for r in repeats.repeat_report(d).collect()}
    assert removed == {1: 0, 2: 30, 3: 0, 4: 0, 5: 0}
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality.quality_report(d).collect()}[3] == 0
    alone = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(d.where("doc_id > 3"), 2).collect()}
    assert alone == {4: 4, 5: 5}


def test_quality_rejects_noise_and_keeps_prose(spark):
    r = random.Random(1)
    prose = " ".join("".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(600))
    noise = " ".join(base64.b64encode(r.randbytes(30)).decode() for _ in range(200))
    again = " ".join(["the same few words again and again, with"] * 3 + [f"x{i}" for i in range(60)]) + " " + "same " * 40
    d = spark.createDataFrame([(1, prose), (2, noise), (3, again * 8)], "doc_id long, text string")
    got = quality.quality_report(d).toPandas().set_index("doc_id")["kept"].to_dict()
    assert got == {1: True, 2: False, 3: False}


def test_repeats(spark):
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(15, 70))] for _ in range(6)]
    rows = []
    for i in range(60):
        ws = []
        for _ in range(r.randint(0, 4)):
            ws += r.choice(passages) if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randint(1, 50))]
        rows.append((i * 3, " ".join(ws) if i else "same " * 90))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    first, want = {}, {}
    for i, text in sorted(rows):
        ws = text.split()
        gone = set()
        for s in range(len(ws) - 19):
            w = tuple(ws[s : s + 20])
            if first.setdefault(w, (i, s)) != (i, s):
                gone |= set(range(s, s + 20))
        kept = [w for j, w in enumerate(ws) if j not in gone]
        want[i] = (len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in repeats.repeat_report(d).collect()}
    assert got == want
    hot = repeats._first_length(repeats.with_versions(d), 20, np.array([], np.uint64)).where("kind = 1").select("h").distinct().collect()
    every = np.array([x["h"] for x in hot], np.int64).view(np.uint64)
    saved = repeats.hot_anchors
    try:  # every anchor hot: the other path gives the same
        repeats.hot_anchors = lambda *a: every
        assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in repeats.repeat_report(d).collect()} == want
    finally:
        repeats.hot_anchors = saved
    stage = {x["doc_id"]: x["text"] for x in repeats.without_repeats(d).collect()}
    assert all(hashlib.sha256(" ".join(stage[i].split()).encode()).hexdigest() == want[i][2] for i in stage)


def brute_components(rows, k, percent):
    sets = {}
    for i, text in rows:
        ws = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} or ({tuple(ws)} if ws else set())
    name = {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    items = sorted(sets)
    for x, i in enumerate(items):
        for j in items[x + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                name[b] = a
    return {i: (len(sets[i]), root(i)) for i in items}


@pytest.mark.parametrize("k", [2, 5])
def test_near_copies(spark, k):
    r = random.Random(k)
    bases = [[f"t{r.randint(0, 400)}" for _ in range(r.randint(30, 90))] for _ in range(8)]
    rows = []
    for i in range(150):
        ws = list(r.choice(bases)) if r.random() < 0.8 else [f"t{r.randint(0, 400)}" for _ in range(40)]
        for _ in range(r.choice((0, 0, 1, 2, 3, 6))):
            ws[r.randrange(len(ws))] = f"e{r.randint(0, 99)}"
        rows.append((i * 2 + 1, " ".join(ws).title() if i % 2 else " ".join(ws)))
    rows += [(900, "one"), (901, "ONE"), (902, ""), (903, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(rows, k, 80)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in nearcopies.near_copies(d, k).collect()}
    assert got == want
    kept = {x["doc_id"] for x in nearcopies.one_of_each(d, k).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_a_large_component_beside_strangers_costs_no_square(spark):
    """Thousands of near copies in one bucket with some that aren't: block pairs are those of the strangers alone."""
    r, base = random.Random(3), [f"b{i}" for i in range(60)]
    placed = [(7, i, 0) for i in range(20_000)] + [(7, 20_000 + i, 20_000 + i) for i in range(5)]
    blocks, pairs = nearcopies._blocks(spark.createDataFrame(placed, "key long, id long, component long"))
    assert blocks.count() == 20_005
    n = -(-20_000 // nearcopies.BLOCK)
    assert pairs.count() == n + 1  # the strangers' block with each of the component's, and with itself
    rows = []
    for i in range(700):
        ws = list(base)
        ws[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(ws)))
    rows += [(700 + j, " ".join(base[: 48 - j] + [f"q{j}{i}" for i in range(12)])) for j in range(5)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == brute_components(rows, 2, 80)


def check_packing(rows, texts):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in rows:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(texts)
    for i, ps in by_doc.items():
        ids, at = ids_of(texts[i]), 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == crc(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    padding = total = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= 2048 and len(ps) <= Limits().segments
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    assert padding <= 0.001 * total


def test_packing(spark, sf, local):
    check_packing(queries.op4_packing(spark, sf).collect(), dict(zip(local["doc_id"], local["text"])))


def test_packing_whole_examples_under_three_limits():
    r, out = random.Random(2), []
    limits = Limits(100, 5, 60)
    p = Packer(limits, lambda *a: out.append(a), cut=False)
    sizes = [(r.randint(1, 60), 0) for _ in range(4000)]
    sizes = [(n, r.randint(0, n)) for n, _ in sizes]
    for i, (n, loss) in enumerate(sizes):
        p.add(i, n, loss)
    p.end()
    bins = defaultdict(list)
    for key, start, length, sequence, offset in out:
        assert start == 0 and length == sizes[key][0]
        bins[sequence].append(key)
    assert sorted(k for b in bins.values() for k in b) == list(range(4000))
    for b in bins.values():
        assert sum(sizes[k][0] for k in b) <= 100 and len(b) <= 5 and sum(sizes[k][1] for k in b) <= 60
    assert sum(n for n, _ in sizes) / (100 * len(bins)) > 0.8
    p.add("big", 101, 0)
    p.add("all loss", 70, 61)
    assert out[-2:] == [("big", 0, 101, None, None), ("all loss", 0, 70, None, None)]


def test_packing_conversations(spark, sf):
    """Real loss counts; each of the three limits is what stops some sequence."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").toPandas()
    want = defaultdict(lambda: [0, 0])
    for t in turns.itertuples():
        n = len(ids_of(t.text))
        want[t.conv_id][0] += n
        want[t.conv_id][1] += n if t.role == "assistant" else 0
    limits = Limits(2048, 8, 1024)
    got = queries.conversation_packing(spark, sf).collect()
    assert {r["example_id"]: [r["n_tokens"], r["n_loss_tokens"]] for r in got} == dict(want)
    bins = defaultdict(list)
    for r in got:
        if r["sequence_id"] is None:
            assert r["n_tokens"] > limits.tokens or r["n_loss_tokens"] > limits.loss_tokens
        else:
            bins[r["sequence_id"]].append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["n_tokens"]
        assert at <= limits.tokens and len(b) <= limits.segments and sum(r["n_loss_tokens"] for r in b) <= limits.loss_tokens
    stops, sizes = Counter(), sorted(want.values())
    for tight in (Limits(300, 99, 9999), Limits(9999, 3, 9999), Limits(9999, 99, 200)):
        out = []
        p = Packer(tight, lambda *a: out.append(a), cut=False)
        for i, (n, loss) in enumerate(sizes):
            p.add(i, n, loss)
        p.end()
        stops[tight] = len({o[3] for o in out if o[3] is not None})
    assert all(n > 1 for n in stops.values())


def test_other_tokenizers_go_whole(spark):
    """A byte-level file, whose tokens hold spaces: ids are the library's own."""
    w = wordids.worker(wordids.tokenizer_path("byte_bpe_50k.json"))
    (t,) = wordids_texts(["Two words,  and more.", "", "~ é"])
    assert not w.by_word and wordids.worker(wordids.tokenizer_path()).by_word
    assert w.encode(t) == [np.array([*w.tokenizer.encode(x, add_special_tokens=False).ids, 1], "<u4").tobytes() for x in ("Two words,  and more.", "", "~ é")]


def wordids_texts(texts):
    return list(textarrays.pieces(pa.array(texts)))


def test_a_dictionary_is_trained_on_small_tables_too(spark, docs):
    files = tokenfiles.write_files(docs)
    dictionary, name, _ = files.dictionary(spark)
    assert len(dictionary) > 1000 and hashlib.sha256(dictionary).hexdigest() == name
    rows = files.blocks(spark).collect()
    assert {r["dictionary_hash"] for r in rows} == {name}
    frame = bytes(rows[0]["payload"][: rows[0]["ends"][0]])
    shared = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    assert len(shared.decompress(frame)) == 2 * rows[0]["counts"][0]
    if zstandard.get_frame_parameters(frame).dict_id:
        with pytest.raises(zstandard.ZstdError):
            zstandard.ZstdDecompressor().decompress(frame)
    two = tokenfiles.write_files(spark.createDataFrame([(1, "a few words of text"), (2, "others")], "doc_id long, text string"))
    assert tokenfiles.read_digests(spark, two).count() == 2 and two.dictionary(spark)[0]


def test_token_files(spark, sf, docs, local):
    files = tokenfiles.write_files(docs)
    got = {r["doc_id"]: r for r in tokenfiles.read_digests(spark, files).collect()}
    start = 0
    for d in local.itertuples():
        ids = ids_of(d.text)
        assert (got[d.doc_id]["start"], got[d.doc_id]["n_tokens"], got[d.doc_id]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    some = {r["doc_id"]: r["ids"] for r in tokenfiles.read_documents(spark, files, [3, 77, 10_000]).collect()}
    assert some == {3: ids_of(local.set_index("doc_id").text[3]), 77: ids_of(local.set_index("doc_id").text[77])}


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: rate * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 40), "en", r.choice(["a", "b", "b", "b", "b", "é", "Z", None]), 0) for i in range(3000)]
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    sizes, each = Counter(), {}
    for i, text, _, source, _ in rows:
        each[i] = (len(text.split()), source)
        sizes[source] += len(text.split())
    want, taken = brute_targets(sizes), Counter()
    got = mixing.mix(d).collect()
    assert len(got) == 3000
    for x in got:
        n, source = each[x["doc_id"]]
        assert x["size"] == n and x["source_size"] == sizes[source] and x["target"] == pytest.approx(want[source]) and x["taken"] in (0, n, 2 * n)
        taken[source] += x["taken"]
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes)
    assert sorted(map(tuple, mixing.mix(d.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)
    rows_out = Counter(x["doc_id"] for x in mixing.mixed_rows(d).collect())
    assert all(rows_out[x["doc_id"]] * x["size"] == x["taken"] for x in got)


def test_mixing_of_repeated_rows(spark):
    """Ten equal rows count ten times, and a source of equal rows alone still meets its target."""
    rows = [(7, "w " * 100, "en", "a", 0)] * 10 + [(i, "w " * (i % 37 + 1), "en", "b", 0) for i in range(100, 400)] + [(None, "u " * 9, "fr", "b", i % 2) for i in range(7)] + [(8, "v " * 5, "en", "c", 0)] * 901
    d = spark.createDataFrame(rows, DOCS).repartition(5)
    sizes, longest = Counter(), Counter()
    for _, text, _, source, _ in rows:
        n = len(text.split())
        sizes[source] += n
        longest[source] = max(longest[source], n)
    want, taken = brute_targets(sizes), Counter()
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(want[x["source"]]) and x["taken"] <= 2 * x["size"]
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    mixed, words = mixing.mixed_rows(d.selectExpr("*", "1 AS _hash", "2 AS of_copies", "3 AS n", "4 AS place_", "5 AS task")).collect(), Counter()
    for x in mixed:
        words[x["source"]] += len(x["text"].split())
        assert (x["_hash"], x["of_copies"], x["n"], x["place_"], x["task"]) == (1, 2, 3, 4, 5)
    assert words == taken


def test_flight_keeps_both_totals():
    r = np.random.default_rng(1)
    p, w, m = r.uniform(0.05, 0.95, 400), r.integers(1, 900, 400).astype(float), np.ones(400)
    q = mixing.flight(p, w, m, r.uniform(size=400))
    assert (q @ w) == pytest.approx(p @ w) and q.sum() == pytest.approx(p.sum()) and ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2


def test_language_held_out(spark, sf, local):
    got = queries.op2_language(spark, sf).toPandas().merge(local, on="doc_id")
    assert got["held_out"].equals(got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2))
    assert (got[got["held_out"]]["lang_pred"] == got[got["held_out"]]["lang"]).mean() >= 0.97
    assert got["score"].between(0, 1).all()
    d = spark.createDataFrame([(2, None), (3, "123 ## "), (5, "")], "doc_id long, text string")
    m = language.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    assert {r["lang_pred"] for r in language.identify(d, m).collect()} == {"und"}


def plain_language(train, texts):
    """The same model by counting: words, then ever shorter n-grams of unseen words."""
    def log_tables(counts, names):
        kept = [w for w, by in counts.items() if sum(by.values()) >= language.LEAST]
        total = {x: sum(counts[w][x] for w in kept) for x in names}
        return {w: [math.log((counts[w][x] + language.ADD) / (total[x] + language.ADD * max(1, len(kept)))) for x in names] for w in kept}

    def words(text):
        return "".join(c if c.isalpha() else " " for c in text.lower()).split()

    names = sorted({x for _, x in train})
    by_word, by_gram = defaultdict(Counter), defaultdict(Counter)
    for text, x in train:
        for w in words(text):
            by_word[w][x] += 1
            for n in range(1, 6):
                for i in range(len(w) + 3 - n):
                    by_gram[f"<{w}>"[i : i + n]][x] += 1
    known, grams = log_tables(by_word, names), log_tables(by_gram, names)

    def score(w):
        if w in known:
            return known[w]
        for n in range(min(5, len(w) + 2), 0, -1):
            found = [grams[g] for g in (f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)) if g in grams]
            if found:
                return [sum(c) / len(found) for c in zip(*found)]
        return [0.0] * len(names)

    out = []
    for text in texts:
        total = [sum(c) for c in zip(*map(score, words(text)))] or None
        out.append((names[total.index(max(total))], 1 / sum(math.exp(x - max(total)) for x in total)) if total else ("und", 0.0))
    return out


def test_language_against_counting(spark, sf, local):
    train = [(d.text, d.lang) for d in local.itertuples() if d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 4 != 2]
    some = local.iloc[::4]
    odd = ["½ ² ①", "plouf trement zzz", "ça", "", "den " * 50]
    want = plain_language(train, [*some["text"], *odd])
    d = spark.createDataFrame([*[(int(i), t) for i, t in zip(some["doc_id"], some["text"])], *[(-i - 1, t) for i, t in enumerate(odd)]], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(d, language.fit(spark.read.parquet(f"{sf}/documents.parquet"))).collect()}
    for i, (name, share) in zip([*some["doc_id"], *[-i - 1 for i in range(len(odd))]], want):
        assert got[int(i)][0] == name and got[int(i)][1] == pytest.approx(share, abs=1e-3)


def test_a_rare_language_keeps_its_words(spark):
    many = [(i, f"the house of the man is number {i}", "en") for i in range(3000)]
    few = [(5000 + i, "ett hus vid sjön är rött", "sv") for i in range(30)]
    m = language.fit(spark.createDataFrame(many + few, "doc_id long, text string, lang string"))
    assert m.languages == ["en", "sv"] and {"hus", "sjön", "rött"} <= set(m.words)
    assert language.words("½ a² ① _x") == ["a", "x"] and m.predict("½ ² ①") == ("und", 0.0)
    assert m.predict("sjön" * 20_000)[0] == "sv"


def test_rows_of_one_id_are_learned_from(spark):
    """Many texts under one doc_id, and many equal rows, beside a small language."""
    few = [(i, f"the house of the man is number {i}", "en") for i in range(50)]
    for doc_id in (3, 4, 7, 8, 11):
        many = [(doc_id, f"ett hus vid sjön är rött {i}", "sv") for i in range(12_000)]
        m = language.fit(spark.createDataFrame(many + few + [(doc_id, "samma rad igen", "da")] * 9_000, "doc_id long, text string, lang string"))
        if zlib.crc32(str(doc_id).encode()) % 4 != 2:
            assert m.languages == ["da", "en", "sv"] and "sjön" in m.words and m.predict("ett hus vid sjön")[0] == "sv"


def test_a_pool_holds_tails_alone(spark):
    """What the packer keeps of long documents is less than a sequence of each."""
    held = []

    class Spy(Packer):
        def fill(self, keep):
            held.append(max(len(k[1]) // 4 for k in self.keys) if self.keys else 0)
            super().fill(keep)

    out = []
    p = Spy(Limits(), lambda key, *x: out.append((key[0], *x)), tail=lambda k, s: (k[0], k[1][4 * s :], s, k[3]))
    for i in range(packing.POOL + 5):
        p.add((i, bytes(4 * 5000), 0, 5000), 5000)
    p.end()
    assert held and max(held) < 2048 and sum(x[2] for x in out) == 5000 * (packing.POOL + 5)


def test_viterbi_is_the_best_of_all_labelings():
    import itertools

    chain = extraction.model()
    for page, _ in labelledpages.labelled_pages(25, seed=77):
        found = extraction.features(extraction.blocks(page))[:9]
        e = chain.scores(found)

        def total(z):
            return chain.start[z[0]] + sum(e[i, x] for i, x in enumerate(z)) + sum(chain.transition[a, b] for a, b in zip(z, z[1:]))

        best = max(itertools.product((0, 1), repeat=len(found)), key=total)
        assert total(chain.decode(found)) == pytest.approx(total(best))


def test_extraction_on_unseen_layouts():
    chain, right, pages = extraction.model(), 0, labelledpages.labelled_pages(200, seed=31)
    for page, labels in pages:
        found = extraction.blocks(page)
        right += chain.decode(extraction.features(found)) == labels
    assert right / len(pages) >= 0.9


def test_extraction_of_articles(spark, sf):
    import html as h

    got = {r["page_id"]: r["text"] for r in queries.op1_extraction(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.sub(r"<[^>]*\Z", "", re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1])
        parts = (re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body))
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)


def looked_at(p, q, tables=True):
    """Votes between two pictures by comparing every corner with every other: of those within the radius all, or those that share a table's part."""
    a, b = media.describe(p[None]), media.describe(q[None])
    bits = [np.unpackbits(np.stack(d[5:], 1).astype("<i8").view(np.uint8), axis=1, bitorder="little") for d in (a, b)]
    near = (bits[0][:, None] != bits[1][None]).sum(2) <= media.RADIUS
    same = np.zeros_like(near)
    for i in range(media.TABLES):
        part = slice(media.TABLE_BITS * i, media.TABLE_BITS * (i + 1))
        same |= (bits[0][:, None, part] == bits[1][None][:, :, part]).all(2)
    cells = defaultdict(set)
    for i, j in zip(*np.nonzero(near & same if tables else near)):
        turn, step = b[4][j] - a[4][i], int(b[3][j] - a[3][i])
        scale, rad = media.SCALE**step, math.radians(turn)
        dx = np.float32(b[1][j]) - scale * (math.cos(rad) * np.float32(a[1][i]) - math.sin(rad) * np.float32(a[2][i]))
        dy = np.float32(b[2][j]) - scale * (math.sin(rad) * np.float32(a[1][i]) + math.cos(rad) * np.float32(a[2][i]))
        at = (math.floor(turn % 360 / media.TURN), math.floor(dx / media.SHIFT), math.floor(dy / media.SHIFT))
        for o in np.ndindex(2, 2, 2):
            cells[step, (at[0] + o[0]) % 12, at[1] + o[1], at[2] + o[2]].add(i)
    return max(map(len, cells.values()), default=0)


def warped(p, turn=0.0, scale=1.0):
    """A picture turned about its centre and scaled, between pixels; made soft first where it gets smaller."""
    h, w = p.shape
    a = p.astype(float)[None]
    if scale < 1:
        a = 0.5 * a + 0.5 * media._box(a, 1)
    y, x = np.mgrid[0 : round(h * scale), 0 : round(w * scale)].astype(float)
    y, x = y - (round(h * scale) - 1) / 2, x - (round(w * scale) - 1) / 2
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    got = media._between(a, np.zeros(y.shape, int), (c * y - s * x) / scale + (h - 1) / 2, (s * y + c * x) / scale + (w - 1) / 2)
    return np.rint(got).astype(np.uint8)


NOISE = np.random.default_rng(8)
EDITS = {
    "cut-out, darker": lambda p: media.edited(p, 13), "quarter turn": lambda p: np.ascontiguousarray(np.rot90(p)), "twice the size": lambda p: warped(p, 0, 2),
    "blurred": lambda p: np.rint(media._box(p[None].astype(float), 1)[0]).astype(np.uint8), "noisy": lambda p: np.clip(p + NOISE.normal(0, 8, p.shape), 0, 255).astype(np.uint8),
    "16 greys": lambda p: (p // 16 * 16 + 8).astype(np.uint8),
}
MEDIA = "media_id long, width int, height int, pixels binary"


def as_row(i, p):
    return i, p.shape[1], p.shape[0], bytearray(p.tobytes())


def test_image_search_against_every_pair(spark):
    """All pairs of pictures and their edits, by the plain comparison; and nine of ten edits of each kind are found."""
    r = np.random.default_rng(9)
    pictures = {}
    for i in range(10):
        p = media.render(r.normal(size=64))
        pictures[100 * i] = p
        for k, edit in enumerate(EDITS.values()):
            pictures[100 * i + k + 1] = edit(p)
    got = {(x["query_id"], x["copy_id"]): x["votes"] for x in media.find_copies(spark.createDataFrame([as_row(*x) for x in pictures.items()], MEDIA)).collect()}
    want = {}
    for q in range(0, 1000, 100):
        for m, p in pictures.items():
            if m != q and (n := looked_at(pictures[q], p)) >= max(media.VOTES, media.SHARE * min(len(media.describe(x[None])[0]) for x in (p, pictures[q]))):
                want[q, m] = n
    assert {k: v for k, v in got.items() if v is not None} == want
    for k, name in enumerate(EDITS):
        assert sum((100 * i, 100 * i + k + 1) in got for i in range(10)) >= 9, name
    assert all(m // 100 == q // 100 for q, m in got)


#: What four tables of 61 bits reach: the least share of pictures found by them, for edits of each kind, and by the radius alone.
REACH = {
    "turned by 3": (lambda p: warped(p, 3), 0.7, 1.0), "turned by 10": (lambda p: warped(p, 10), 0.5, 1.0), "turned by 45": (lambda p: warped(p, 45), 0.0, 1.0),
    "half the size": (lambda p: warped(p, 0, 0.5), 0.2, 0.2), "0.95 of the size": (lambda p: warped(p, 0, 0.95), 0.1, 1.0), "1.5 times the size": (lambda p: warped(p, 0, 1.5), 0.0, 0.0),
    "noise of 15": (lambda p: np.clip(p + np.random.default_rng(4).normal(0, 15, p.shape), 0, 255).astype(np.uint8), 0.0, 1.0),
}


def share_found(edit, tables, n=10):
    r, found = np.random.default_rng(21), 0
    for _ in range(n):
        p = media.render(r.normal(size=64))
        q = edit(p)
        found += looked_at(p, q, tables) >= max(media.VOTES, media.SHARE * min(len(media.describe(x[None])[0]) for x in (p, q)))
    return found / n


@pytest.mark.parametrize("kind", REACH)
def test_reach_of_image_search_beyond_its_edits(kind):
    """Stated bounds, not aims: edits that the tables reach in part or not at all, beside a twin that asks for the radius alone."""
    edit, by_tables, by_radius = REACH[kind]
    assert share_found(edit, True) >= by_tables and share_found(edit, False) >= by_radius


def test_the_radius_alone_links_no_strangers():
    r = np.random.default_rng(33)
    p = [media.render(r.normal(size=64)) for _ in range(8)]
    least = lambda a, b: max(media.VOTES, media.SHARE * min(len(media.describe(x[None])[0]) for x in (a, b)))
    assert not [(i, j) for i in range(8) for j in range(i) if looked_at(p[i], p[j], False) >= least(p[i], p[j])]


@pytest.mark.parametrize("kind", EDITS)
def test_tables_miss_little_of_what_the_radius_finds(kind):
    assert share_found(EDITS[kind], True) >= 0.9 * share_found(EDITS[kind], False) >= 0.8


def test_a_logo_in_every_image(spark, monkeypatch):
    """Frequent part values are asked for once, for a leader; all that share them are linked to it, and real copies are still found."""
    monkeypatch.setattr(media, "HOT", 5)
    r = np.random.default_rng(12)
    logo, rows = media.render(r.normal(size=64)), []
    for i in range(24):
        p = np.concatenate([media.render(r.normal(size=64)), np.full((60, 80), 128, np.uint8), logo])  # no patch reaches into both
        rows.append(as_row(100 * i, p))
        if i % 4 == 0:
            rows.append(as_row(100 * i + 1, media.edited(p, i)))
    got = {(x["query_id"], x["copy_id"]) for x in media.find_copies(spark.createDataFrame(rows, MEDIA)).collect()}
    assert {(0, i[0]) for i in rows} <= got and {(100 * i, 0) for i in range(24)} <= got
    assert sum((100 * i, 100 * i + 1) in got for i in range(0, 24, 4)) >= 5
    q = spark.createDataFrame([(7, i, 0) for i in range(100, 140)] + [(8, 100, 1), (8, 120, 1)], "key long, q_id long, q_n int")
    m = spark.createDataFrame([(7, i, 0) for i in range(1000)] + [(8, i, 1) for i in range(50)], "key long, m_id long, m_n int")
    pairs, hot = media._asked(q, m)
    assert [r["key"] for r in hot.collect()] == [7]
    assert {(r["key"], r["q_id"]): r["count"] for r in pairs.groupBy("key", "q_id").count().collect()} == {(7, 100): 1000, (8, 100): 50, (8, 120): 50}


def test_cut_and_darkened_copies_are_found(spark, sf):
    got = queries.op10_image_copies(spark, sf).toPandas()
    edited = set(map(tuple, got[["query_id", "copy_id"]].values.tolist()))
    asked = got["query_id"].unique()
    assert np.mean([(q, q + 1) in edited for q in asked]) >= 0.9
    assert ((got["copy_id"] == got["query_id"]) | (got["copy_id"] == got["query_id"] + 1)).mean() >= 0.95


def test_a_small_part_of_a_large_picture_is_found(spark):
    """Cut-outs of 80 x 80 of 800 x 800: a hundredth of the area."""
    r = np.random.default_rng(10)
    rows = []
    for i in range(4):
        p = media.render(r.normal(size=64), side=800, grain=240)
        cut = np.ascontiguousarray(p[90 * i + 111 : 90 * i + 191, 301 : 381])
        rows += [(100 * i, 800, 800, bytearray(p.tobytes())), (100 * i + 1, 80, 80, bytearray(cut.tobytes()))]
    got = media.find_copies(spark.createDataFrame(rows, "media_id long, width int, height int, pixels binary")).toPandas()
    found = set(map(tuple, got[["query_id", "copy_id"]].values.tolist()))
    assert found == {(100 * i, 100 * i + k) for i in range(4) for k in (0, 1)}


def test_pipeline_is_its_stages(spark, sf, local):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    limits = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = [r["doc_id"] for r in quality.quality_report(docs, limits).where("kept").collect()]
    rows = {d.doc_id: d.text for d in local.itertuples() if d.doc_id in set(kept)}
    near = brute_components(sorted(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if near[i][1] == i}
    first = {}
    for i in sorted(rows):
        ws, gone = WORDS.findall(rows[i]), set()
        for s in range(len(ws) - 19):
            if first.setdefault(tuple(ws[s : s + 20]), (i, s)) != (i, s):
                gone |= set(range(s, s + 20))
        if gone:
            rows[i] = " ".join(w for j, w in enumerate(ws) if j not in gone)
    d = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], (kept, rows, rows), strict=True):
        d = stage(spark, d, sf)
        assert {r["doc_id"] for r in d.select("doc_id").collect()} == set(want), name
    assert {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} == rows
    pieces = corpus_pipeline.run(spark, sf).collect()
    mixed = {r["doc_id"]: r["copies"] for r in mixing.mix(d).collect()}
    whole = Counter()
    for p in pieces:
        whole[p["doc_id"]] += p["length"]
    assert whole == Counter({i: n * len(ids_of(rows[i])) for i, n in mixed.items() if n})
