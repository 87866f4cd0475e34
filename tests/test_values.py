"""Values of sequential and statistical operators against hand vectors and plain walks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceforge.operators import peaks as pk
from traceforge.operators import sequences as sq
from traceforge.plans import registry
from traceforge.schema import M13_REFERENCE

SF = "/root/testdata/sf0.01"


def bell(n, *tops):
    x = np.arange(n)
    return sum(h * np.exp(-0.5 * ((x - at) / w) ** 2) for at, h, w in tops)


def long(spark, wells):
    rows = [("p", w, "c1", i, float(v)) for w, y in wells.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "plate string, well string, channel string, scan long, y double")


def test_broad_groups_split_at_their_parts_only(spark):
    two, one, narrow = bell(300, (120, 900, 10), (160, 600, 10)), bell(300, (140, 900, 25)), bell(300, (140, 900, 3))
    d = long(spark, {"two": two, "one": one, "narrow": narrow})
    groups = [("p", w, "c1", 140, 900.0, 7.0, lo, hi) for w, lo, hi in (("two", 90, 190), ("one", 80, 200), ("narrow", 133, 147))]
    g = spark.createDataFrame(groups, "plate string, well string, channel string, scan long, height double, area double, left long, right long")
    got = {}
    for r in pk.split_broad(d, g, 50, 5).orderBy("well", "scan").collect():
        got.setdefault(r["well"], []).append((r["scan"], r["height"], r["area"], r["n_parts"]))
    assert got["one"] == got["narrow"] == [(140, 900.0, 7.0, 1)]
    assert [(x[0], x[3]) for x in got["two"]] == [(120, 2), (160, 2)]
    for at, height, area, _ in got["two"]:
        assert height == two[at] and area == pytest.approx(np.trapezoid(two[at - 8 : at + 9]))


def test_parts_of_a_group_without_a_trace_or_of_an_empty_table(spark):
    d = long(spark, {"A": bell(100, (50, 10, 3))})
    g = spark.createDataFrame([], "plate string, well string, channel string, scan long, height double, area double, left long, right long")
    assert pk.split_broad(d, g, 50, 5).count() == 0


def test_alignment_lines_spell_both_texts(spark):
    """Gap-free lines are the aligned stretches; bars stand under equal letters alone, as many as matches."""
    part = M13_REFERENCE[100:160]
    texts = [part, part[:30] + part[31:], part[:30] + "A" + part[30:], part[:20] + "N" + part[21:], "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "item_id long, sequence string")
    rows = {r["item_id"]: r for r in sq.align(d, M13_REFERENCE).withColumn("bars", sq.match_line(F.col("query_line"), F.col("ref_line"))).collect()}
    for i in range(4):
        r = rows[i]
        q, ref = r["query_line"], r["ref_line"]
        assert len(q) == len(ref) == len(r["bars"]) == r["aligned"]
        assert q.replace("-", "") in texts[i] and ref.replace("-", "") in M13_REFERENCE
        assert r["bars"] == "".join("|" if a == b != "-" else " " for a, b in zip(q, ref)) and r["bars"].count("|") == r["matches"]
    assert rows[0]["bars"] == "|" * 60 and rows[0]["identity"] == 1.0 and "-" in rows[1]["query_line"] and "-" in rows[2]["ref_line"]
    assert rows[4]["aligned"] == rows[5]["aligned"] == 0


def test_labels_move_through_the_lines_of_the_query(spark):
    aligned = registry.queries()["sw_align"](spark, SF).where("identity >= 0.5 AND length(sequence) >= 50").toPandas()
    want = set()
    for r in aligned.itertuples():
        at = r.query_start
        for a, b in zip(r.query_line, r.ref_line):
            if a != "-" and b != "-":
                want.add((str(r.item_id), at, b))
            at += a != "-"
    got = registry.queries()["label_transfer"](spark, SF).toPandas()
    assert want and {tuple(x) for x in got[["variant", "position", "base"]].itertuples(index=False)} == want


def test_best_standards_are_candidates_four_to_a_well(spark):
    got = registry.queries()["standard_calls"](spark, SF).toPandas()
    from traceforge.plans import views as v

    known = {tuple(r) for r in v.peaks(spark, SF, ("c3",)).select("plate", "well", "scan").collect()}
    assert len(got) and got.groupby(["plate", "well"]).size().max() <= 4 and not got.duplicated(["plate", "well", "scan"]).any()
    assert {tuple(x) for x in got[["plate", "well", "scan"]].itertuples(index=False)} <= known
    if "score" in got:
        assert got["score"].between(0, 1).all()


def test_the_peak_forest_is_scored_on_held_out_peaks(spark):
    (r,) = registry.queries()["peak_forest"](spark, SF).collect()
    assert r["trees"] > 0 and 0.5 < r["held_out"] <= 1 and 0.5 < r["cross_validated"] <= 1 and abs(r["held_out"] - r["cross_validated"]) < 0.2


def test_the_fitted_matrix_counts_every_sample_once(spark):
    from traceforge.plans import views as v

    got = registry.queries()["fitted_matrix"](spark, SF).toPandas()
    assert got["n"].sum() == v.samples(spark, SF).count() and (got["n_ok"] <= got["n"]).all() and not got["base"].duplicated().any()
