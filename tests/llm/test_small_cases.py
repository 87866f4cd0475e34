"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

from types import SimpleNamespace

import pytest

import corpus_pipeline
from traceforge.llm import extraction, htmlblocks, language, licences, media, mixing, nearcopies, packing, quality, repeats, scratch, tokenfiles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"w{i * 7919 % 911} and the{i % 13} of{i * 31 % 97}x" for i in range(40))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, no words, one word, a very long text, repeated rows."""
    long_text = " ".join(f"lang{i * 7919 % 100003}" for i in range(40_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, "word", "en", "b", 4), (None, "no id here", "en", "a", 10), (5, PROSE, "en", "a", len(PROSE)),
        (5, PROSE, "en", "a", len(PROSE)), (6, PROSE, None, "b", len(PROSE)), (7, long_text, "en", "a", len(long_text)), (8, "é ü 漢字 <|endoftext|> ~ \x00 ok", "fr", None, 20),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def _fit_identify(d):
    return language.identify(d, language.fit(d))


def _files(d):
    return tokenfiles.read_digests(d.sparkSession, tokenfiles.write_files(d))


OPERATORS = {
    "language": _fit_identify, "licences": licences.licence_scan, "mixing": mixing.mix, "quality": quality.quality_report, "token files": _files,
    "repeats": repeats.repeat_report, "near copies": nearcopies.near_copies,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(name, odd):
    assert OPERATORS[name](odd).count() == 10


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, none):
    assert OPERATORS[name](none).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(name, odd):
    extra = odd.selectExpr("*", "1 AS size", "2 AS n", "'x' AS h", "3 AS kept", "4 AS ranges", "5 AS z", "6 AS component_id", "7 AS hash", "8 AS copies")
    assert OPERATORS[name](extra).count() == 10


def test_packing_small_cases(odd, none):
    assert packing.pack_documents(none).count() == 0
    got = packing.pack_documents(odd).toPandas()
    assert sorted(got[got["doc_id"].isin([1, 2, 3])]["length"]) == [1, 1, 1]
    whole = got.groupby("doc_id")["length"].sum()
    assert whole[7] == got[got["doc_id"] == 7]["doc_tokens"].iloc[0]


#: Names that operators and stages use inside.
INNER = "size n h kept ranges z component_id hash copies _hash _n _s _d _h _ranges version many gone of_doc of_version ranges_gone of_source of_hash of_copies of_rows place_ text_hash task sig lo hi DOC_ID_K".split()


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_with_clashing_columns(name, stage, spark, odd, sf):
    """Extra columns of any name come through unchanged."""
    extra = odd.selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(INNER)])
    got = stage(spark, extra, sf)
    if name == corpus_pipeline.STAGES[-1][0]:
        assert got.count() > 0
    else:
        assert got.columns == extra.columns
        assert all([r[c] for c in INNER] == list(range(len(INNER))) for r in got.collect())


def test_versions_of_one_id(spark):
    """Texts under one doc_id lose what is theirs to lose, each by its own words."""
    a, b = [" ".join(f"{x}{i}" for i in range(30)) for x in "ab"]
    d = spark.createDataFrame([(1, a), (5, b), (5, f"{a} {b}"), (9, b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in repeats.repeat_report(d).collect())
    assert got == [(1, 30, 0), (5, 30, 0), (5, 60, 60), (9, 30, 30)]
    kept = sorted((r["doc_id"], r["text"]) for r in repeats.without_repeats(d).collect())
    assert kept == [(1, a), (5, ""), (5, b), (9, "")]


def test_scratch_needs_a_shared_folder_on_clusters():
    def session(master):
        conf = SimpleNamespace(get=lambda k, d=None: {"spark.master": master}.get(k, d))
        return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, applicationId=master), conf=SimpleNamespace(get=lambda k, d=None: d))

    for master in ("spark://elsewhere:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            scratch.shared_dir(session(master))
    assert scratch.shared_dir(session("local[4]")) == scratch.shared_dir(session("local[4]")) != scratch.shared_dir(session("local"))


def test_quotes_in_tags():
    got = [b.text for b in htmlblocks.blocks("<p don't>First block.</p><p title='a>b' class=x\"y>Second block.</p><p>So <math><mi>x</mi>=1</math> holds.</p>")]
    assert got == ["First block.", "Second block.", "So x=1 holds."]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages(name, stage, spark, odd, none, sf):
    assert stage(spark, none, sf).count() == 0
    got = stage(spark, odd, sf)
    got.count()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == odd.columns and [f.dataType for f in got.schema] == [f.dataType for f in odd.schema]


def test_repeats_of_equal_rows_stay(odd):
    got = repeats.repeat_report(odd).toPandas()
    assert got[got["doc_id"] == 5]["n_removed"].tolist() == [0, 0]
    assert got[got["doc_id"] == 6]["n_removed"].tolist() == [len(PROSE.split())]


def test_near_copies_of_nothing(odd):
    got = nearcopies.near_copies(odd, 2).toPandas()
    assert got[got["doc_id"].isin([1, 2, 3])]["n_shingles"].tolist() == [0, 0, 0]
    assert got[got["doc_id"] == 6]["component_id"].tolist() == [5]
    assert bool(got[got["doc_id"].isna()]["kept"].iloc[0])


def test_pages(spark):
    kind = "page_id long, url string, html string"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain text &amp; more"), (4, "u", "<article><p>Kept text of the article.</p><p>Second block here.<p>cut &am"), (5, "u", "<script>var x"), (6, "u", "<p"), (None, "u", "<article><p>a<p>b</article>"), (7, "u", "<article>" + "<p>Some words of text.</p>" * 3000 + "</article>")]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, kind)).collect()}
    assert (got[1], got[2], got[5], got[6]) == ("", "", "", "")
    assert got[4] == "Kept text of the article.\nSecond block here.\ncut &am"
    assert got[None] == "a\nb" and got[7].count("\n") == 2999
    assert extraction.extract(spark.createDataFrame([], kind)).count() == 0


def test_images(spark):
    kind = "media_id long, width int, height int, pixels binary"
    flat = bytearray(80 * 80)
    rows = [(100, 80, 80, flat), (101, 80, 80, flat), (200, None, None, None), (300, 3, 3, bytearray(9)), (None, 80, 80, flat)]
    got = media.find_copies(spark.createDataFrame(rows, kind)).toPandas()
    assert got[got["query_id"] == 100]["n_rows"].tolist() == [3]
    assert media.find_copies(spark.createDataFrame([], kind)).count() == 0


@pytest.mark.parametrize("notice", [n for n in licences.TEMPLATES if n not in licences.BASE])
def test_prose_does_not_crowd_out_a_notice(notice, spark):
    """The notice's label, also after every other template's words in another order and after other notices."""
    words = sorted({w for _, t, _ in licences.TEMPLATES.values() for w in t.split()})
    label, text, _ = licences.TEMPLATES[notice]
    others = " . ".join(t for n, (_, t, _) in licences.TEMPLATES.items() if n != notice)
    rows = [(1, text), (2, " ".join(words) + " so " + text), (3, others + " . " + text)]
    got = {r["doc_id"]: r["labels"].split(",") for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i] for i in (1, 2, 3))


def test_heads_comments_and_references():
    texts = lambda page: [b.text for b in htmlblocks.blocks(page)]
    assert texts("<html><head><title>T</title><article><p>First.</p><p>Second.</p></article></html>") == ["First.", "Second."]
    assert texts("<head><meta charset=x><style>a</style>Text here<p>Second.") == ["Text here", "Second."]
    assert texts("<html><head><link href=y> \n <script>a</script></head><body><p>Ok.</p>") == ["Ok."]
    assert texts("One.<!-- a --!>Two.<!--> Three<!---> Four<!-- x -- > y --> Five <!-- end") == ["One.Two. Three Four Five"]
    assert texts("&am<b></b>p; &amp; &lt;b&gt; &#x41;") == ["&amp; & <b> A"]


def test_deep_pages_in_seconds():
    import time

    began = time.time()
    for page in ("<div>a" * 100_000, "<p><div>" + "<center>b" * 100_000, "<b>" * 100_000 + "<p>c</p>" * 10, "<li><div class='content'>x</p>" * 50_000):
        assert htmlblocks.blocks(page)
    assert extraction.main_text("<div>a" * 20_000, extraction.model()).count("a") in range(20_001)
    assert time.time() - began < 60


def test_pages_repeated_tied_and_with_clashing_columns(spark):
    page = "<article><p>Some words of the text stand here.</p><p>More of them follow here.</p></article>"
    d = spark.createDataFrame([(1, "u", page), (1, "u", page), (1, "v", page), (None, None, None)], "page_id long, url string, html string")
    got = extraction.extract(d.selectExpr("*", "1 AS text", "2 AS n_chars")).collect()
    assert sorted(r["text"] for r in got) == [""] + ["Some words of the text stand here.\nMore of them follow here."] * 3


MARKS_AND_HEADERS = {
    "MIT License": "mit",
    "SPDX-License-Identifier: MIT": "mit",
    "# SPDX-License-Identifier: BSD-3-Clause\nimport os": "bsd-3-clause",
    "Data: Apache-2.0.": "apache-2.0",
    "Text by A., CC BY-NC 4.0": "cc-by,cc-by-nc-4.0",
    "Creative Commons Attribution 4.0 International": "cc-by-4.0",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted": "isc",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl,gpl-3.0",
    "the license of the general, version 3; permission reserved": "",
    "GNU GENERAL PUBLIC LICENSE": "gpl",
}


def test_licence_marks_identifiers_and_headers(spark):
    texts = list(MARKS_AND_HEADERS)
    got = {r["doc_id"]: r["labels"] for r in licences.licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: MARKS_AND_HEADERS[t] for i, t in enumerate(texts)}


def test_each_licence_template_has_one_rare_mandatory_anchor_and_a_mark():
    import re

    anchors = {name: word for word, name, _ in licences._anchors()}
    assert set(anchors) == set(licences.TEMPLATES)
    for name, (_, text, phrases) in licences.TEMPLATES.items():
        assert anchors[name] in " ".join(phrases).split() and all(f" {p} " in f" {text} " for p in phrases)
        assert any(re.search(licences.MARKS, p) for p in phrases), name
