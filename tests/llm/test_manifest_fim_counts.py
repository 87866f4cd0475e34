"""Merkle manifest, fill-in-the-middle and token counts against plain versions and on small cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from traceforge.llm import bytepairs, fim, merkle, queries, rope, textarrays, tokencounts, wordids

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- Merkle


def plain_leaf(d, n_chars):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d["doc_id"], d["source"], d["lang"], n_chars, d["text"])])


def plain_tree(nodes):
    """The root, and per leaf its (left, right) siblings."""
    paths, level, owners = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(level) > 1:
        runs = [range(i, min(i + 2, len(level))) for i in range(0, len(level), 2)]
        for run in runs:
            for k in run:
                step = ("".join(level[j] for j in run if j < k), "".join(level[j] for j in run if j > k))
                for leaf in owners[k]:
                    paths[leaf].append(step)
        owners = [[x for k in run for x in owners[k]] for run in runs]
        level = [sha(*[level[k] for k in run]) for run in runs]
    return level[0], paths


def plain_manifest(rows):
    by_lang, out = {}, []
    for d in rows:
        by_lang.setdefault(d["lang"], []).append(d)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    first = lambda i: (i is not None, i or 0)
    trees = {}
    for g in langs:
        by_lang[g].sort(key=lambda d: (first(d["doc_id"]), plain_leaf(d, d["n_chars"])))
        trees[g] = plain_tree([plain_leaf(d, d["n_chars"]) for d in by_lang[g]])
    root, tops = plain_tree([trees[g][0] for g in langs])
    for g, top in zip(langs, tops):
        for d, path in zip(by_lang[g], trees[g][1]):
            path = path + top
            bad = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0 and d["n_chars"] is not None
            node = plain_leaf(d, d["n_chars"] + 1 if bad else d["n_chars"])
            for a, b in path:
                node = sha(a, node, b)
            out.append((str(d["doc_id"]), plain_leaf(d, d["n_chars"]), trees[g][0], root, sha(*[x for s in path for x in s]), node, node == root))
    return sorted(out)


def found_manifest(df):
    longer = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    tampered = merkle.digest(*[merkle.framed(longer if c == "n_chars" else F.col(c)) for c in merkle.FIELDS])
    d = merkle.manifest(df, carry={"tampered": tampered})
    d = d.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof"), merkle.folded(F.col("tampered"), F.col("path")).alias("folded"))
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof"], r["folded"], r["folded"] == r["root"]) for r in d.collect())


def some_documents(sizes, seed):
    r = random.Random(seed)
    rows = [{"doc_id": i, "text": f"text {i} é", "lang": lang, "source": r.choice([None, "a", "b"]), "n_chars": r.choice([None, i, 9])} for lang, n in sizes for i in r.sample(range(10_000), n)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [[("en", 1)], [("en", 7), (None, 1), ("ü", 3), ("", 2)], [("en", 257), ("fr", 256), ("de", 255), (None, 5)], [("en", 600)], [(f"l{i}", 1 + i % 3) for i in range(20)]])
def test_manifest(spark, sizes):
    rows = some_documents(sizes, len(sizes))
    df = spark.createDataFrame([tuple(d[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for d in rows], DOCS).repartition(5)
    assert found_manifest(df) == plain_manifest(rows)


def test_manifest_of_three_levels_of_blocks(spark, monkeypatch):
    """Blocks of four: trees of many spans."""
    monkeypatch.setattr(merkle, "SPAN", 2)
    rows = some_documents([("en", 70), ("fr", 16), ("de", 1)] + [(f"x{i}", 2) for i in range(6)], 3)
    df = spark.createDataFrame([tuple(d[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for d in rows], DOCS).repartition(3)
    assert found_manifest(df) == plain_manifest(rows)


def test_manifest_small_cases(spark):
    """Nulls, empty texts, repeated rows and ids, clashing columns, no rows."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (1, "other", "en", None, 5), (None, "x", "en", "s", None), (2, "é" * 50_000, None, "s", 1)]
    names = ("doc_id", "text", "lang", "source", "n_chars")
    df = spark.createDataFrame(rows, DOCS)
    clash = df.selectExpr("*", "1 AS leaf", "2 AS path", "3 AS g", "4 AS idx", "5 AS n", "6 AS node", "7 AS _at", "8 AS _part", "9 AS block", "'x' AS subroot", "1 AS _tie", "2 AS _group", "3 AS tampered")
    want = plain_manifest([dict(zip(names, r)) for r in rows])
    assert found_manifest(df) == want and found_manifest(clash) == want
    assert merkle.manifest(df.limit(0)).count() == 0


# ---- fill-in-the-middle


@pytest.mark.parametrize("unit", [None, r"\w+\W*", r"."])
def test_ropes(unit):
    """Any split gives the units on either side; joining gives the text."""
    r = random.Random(5)
    pattern = re.compile(unit, re.DOTALL) if unit else None
    for _ in range(150):
        text = "".join(r.choice("ab é漢😀\n") for _ in range(r.randint(0, 60)))
        starts = list(range(len(text))) if not unit else [m.start() for m in pattern.finditer(text)] or [0]
        if text:
            starts[0] = 0
        tree = rope.rope(text, pattern, leaf=r.choice([1, 4, 16]))
        n = rope.units(tree)
        assert n == (len(starts) if text else 0) and rope.chars(tree) == len(text) and rope.flat(tree) == text
        k = r.randint(0, n)
        left, right = rope.split(tree, k)
        at = starts[k] if k < n else len(text)
        assert (rope.flat(left), rope.flat(right), rope.units(left), rope.chars(right)) == (text[:at], text[at:], k, len(text) - at)
        j = r.randint(0, n - k)
        a, b = rope.split(right, j)
        assert rope.flat(rope.join(b, a, left)) == rope.flat(b) + rope.flat(a) + text[:at]


def test_fim_rows(spark, sf):
    got = {r["doc_id"]: r for r in queries.op12_fill_in_middle(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        t = d["text"] or ""
        h = [int(hashlib.sha256(f"1:{d['doc_id']}".encode()).hexdigest()[k : k + 8], 16) for k in range(0, 32, 8)]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        p, m, s = t[:a], t[a:b], t[b:]
        plain = not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        r = got[d["doc_id"]]
        assert (r["n"], r["form"], r["output_sha256"], r["restored_sha256"]) == (len(t), form, sha(out), sha(t))
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if plain else (a, b - a))


def test_fim_small_cases(spark):
    rows = [(i, t) for i, t in enumerate(["", None, "<P", "a<S>b", "<", "<<", "é", "P>", "漢字" * 30_000, "S>x<M", "\x00"])] * 2 + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS form", "2 AS output", "3 AS restored")
    for rules in (fim.Rules(percent=100), fim.Rules(percent=100, spm_percent=100, unit=r"\w+\W*"), fim.Rules("[[a", "[[b", "[[c", 100, 50)):
        got = fim.fim_documents(df, rules).collect()
        assert len(got) == 23 and sorted(str(r["restored"]) for r in got) == sorted(t or "" for _, t in rows)
        assert {r["form"] for r in got if r["doc_id"] in (0, 1)} == {"plain"}
    assert fim.fim_documents(df.limit(0)).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "ba", "c"), ("<P>", "<P>x", "<M>")):
        with pytest.raises(ValueError):
            fim.Rules(*bad)


# ---- token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(wordids.tokenizer_path("byte_bpe_50k.json"))
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def counted(texts, most=2 << 20):
    w = bytepairs.worker(wordids.tokenizer_path("byte_bpe_50k.json"))
    return np.concatenate([w.counts(p) for p in textarrays.pieces(pa.array(texts, pa.string()), most)]).tolist()


def test_counts_of_all_documents(spark, sf, library):
    docs = {d["doc_id"]: d["text"] or "" for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op13_token_counts(spark, sf).collect()
    assert len(got) == len(docs)
    want = dict(zip(docs, library(list(docs.values()))))
    for r in got:
        n = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 512)


@pytest.mark.parametrize("rounds", [0, 2, bytepairs.ROUNDS])
def test_counts_of_odd_texts(rounds, library, monkeypatch):
    """Blanks, endings, classes of characters, special strings whole and cut, long runs; also rank by rank."""
    monkeypatch.setattr(bytepairs, "ROUNDS", rounds)
    r = random.Random(rounds)
    bits = ["a", "b", "s", "t", "re", "ve", "ll", "'", "''", " ", "  ", "\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "1", "23", "٣", "!", "#", "é", "漢字", "́", "<|endoftext|>", "<|endof", "|>", "😀", "aaaa", "the ", "'S", "\x00", "՘", "Ⅷ", "²", "don't", "I'll've"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    texts += ["<|endof", "text|>", "", "a" * 1000, "ab" * 900, " " * 500, "\n" * 77 + "x", "".join(r.choice("aab!") for _ in range(3000)), "".join(r.choice("etaoin") for _ in range(5000))]
    for most in (2 << 20, 40):
        assert counted(texts, most) == library(texts)


def test_character_classes(library):
    """Characters of all planes among letters, numbers and marks, as the library's Unicode version has them."""
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    some = points[:0x3000] + points[0x3000::37]
    texts = ["".join(f"a{chr(c)}1 {chr(c)}!\n{chr(c)}" for c in some[k : k + 50]) for k in range(0, len(some), 50)]
    assert counted(texts) == library(texts)


def test_counts_small_cases(spark):
    rows = [(1, None), (2, ""), (None, "word"), (None, "word"), (3, "x" * 100_000), (4, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_bytes", "2 AS n_tokens", "'x' AS over_limit")
    got = sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_tokens"]) for r in tokencounts.token_counts(df).where("doc_id IS NULL OR doc_id <> 3").collect())
    assert got == [(0, 4, 1), (0, 4, 1), (1, 0, 0), (2, 0, 0), (4, 13, 1)]
    assert tokencounts.token_counts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bytepairs.BytePairs(wordids.tokenizer_path("word_bpe_49k.json"))
