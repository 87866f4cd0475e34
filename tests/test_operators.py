"""Operators on small frames: edge cases, tie rules, settings, and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceforge.operators import basecall as bc
from traceforge.operators import genotype as gt
from traceforge.operators import joins as jn
from traceforge.operators import learning as ln
from traceforge.operators import edits as ed
from traceforge.operators import peaks as pk
from traceforge.operators import sequences as sq
from traceforge.operators import signal as sg
from traceforge.schema import SPECTRAL_MATRIX

LONG = "plate string, well string, channel string, scan long, y double"
TRACE = "plate string, well string, scan long, c1 double, c2 double, c3 double, c4 double, current double"


def long(spark, y, well="A01"):
    return spark.createDataFrame([("p", well, "c1", i, float(v)) for i, v in enumerate(y)], LONG)


def test_short_traces_are_left_raw(spark):
    got = sg.smooth(long(spark, [1, 5, 2]), 7).orderBy("scan").toPandas()
    assert got["smooth"].tolist() == [1, 5, 2]


def test_smoothing_keeps_quadratics_to_the_ends(spark):
    y = [0.5 * i * i - 3 * i + 2 for i in range(12)]
    got = sg.smooth(long(spark, y), 7).orderBy("scan").toPandas()
    assert np.allclose(got["smooth"], y)


def test_noise_of_short_flat_and_long_traces(spark):
    assert sg.noise_level(long(spark, [3.0] * 20)).first()["noise"] == 1.0
    assert sg.noise_level(long(spark, [3.0] * 250)).first()["noise"] == 1e-10
    assert sg.noise_level(long(spark, [3.0] * 20), short="one").first()["noise"] == 1.0


@pytest.mark.parametrize(("whole", "base"), [(False, 2.5), (True, 2.0)])
def test_first_median_in_both_settings(spark, whole, base):
    assert sg.first_median_baseline(long(spark, [1, 2, 3, 4]), whole_numbers=whole).first()["baseline"] == base


def test_empty_traces_give_no_rows(spark):
    empty = long(spark, [])
    assert sg.smooth(empty).count() == 0 and pk.local_maxima(empty).count() == 0
    assert pk.detect(empty, height=1).count() == 0 and sg.als_baseline(empty, 10).count() == 0
    assert pk.threshold_groups(empty, 0.5, 3).count() == 0


def test_unmixing_undoes_mixing(spark):
    true = np.array([[100.0, 0, 0, 0], [5, 70, 0, 2]])
    mixed = true @ np.array(SPECTRAL_MATRIX).T
    d = spark.createDataFrame([("p", "A01", i, *map(float, r), 1.0) for i, r in enumerate(mixed)], TRACE)
    got = sg.unmix(d, SPECTRAL_MATRIX).orderBy("scan").select("d1", "d2", "d3", "d4").toPandas().to_numpy()
    assert np.allclose(got, true, atol=1e-9)
    with pytest.raises(ValueError):
        bc.check_matrix(np.eye(4) * 0.5)


def test_resampling_a_line_is_the_line(spark):
    got = sg.resample(long(spark, [0, 10, 20, 30]), 7).orderBy("point").toPandas()
    assert np.allclose(got["y"], np.linspace(0, 30, 7)) and got["point"].tolist() == list(range(7))
    assert sg.resample(long(spark, [4]), 3).toPandas()["y"].tolist() == [4, 4, 4]


def test_detector_areas_and_stutter(spark):
    x = np.arange(120)
    y = 1000 * np.exp(-0.5 * ((x - 40) / 3) ** 2) + 800 * np.exp(-0.5 * ((x - 90) / 3) ** 2)
    got = pk.detect(long(spark, y), height=100, prominence=50, distance=5, width=1).orderBy("scan").toPandas()
    assert got["scan"].tolist() == [40, 90]
    assert got["area"][0] == pytest.approx(1000 * 3 * np.sqrt(2 * np.pi), rel=0.03)
    one = pk.detect(long(spark, y), height=100, stutter=60).toPandas()
    assert one["scan"].tolist() == [40] and one["count"].tolist() == [2]
    assert pk.detect(long(spark, y), height=100, scan_range=(50, 100)).toPandas()["scan"].tolist() == [90]


def test_stutter_chains(spark):
    d = spark.createDataFrame([("p", "A01", "c1", s, h) for s, h in ((10, 1.0), (14, 3.0), (19, 3.0), (30, 2.0))], "plate string, well string, channel string, scan long, height double")
    got = pk.stutter_groups(d, 5).orderBy("scan").toPandas()
    assert got[["scan", "first_scan", "last_scan", "n_merged"]].values.tolist() == [[14, 10, 19, 3], [30, 30, 30, 1]]


def test_channel_of_base_peaks_in_both_settings(spark):
    y = np.zeros((40, 4))
    y[10, 0], y[30, 3] = 100, 90
    d = spark.createDataFrame([("p", "A01", i, *map(float, r), 1.0) for i, r in enumerate(y)], TRACE)
    assert pk.detect_for_bases(d).orderBy("scan").toPandas()[["scan", "channel"]].values.tolist() == [[7, "c1"], [33, "c4"]]
    assert set(pk.detect_for_bases(d, last_channel=True).toPandas()["channel"]) == {"c4"}


def test_edits_overlay_and_fold(spark):
    peaks = spark.createDataFrame([("p", "A01", "c1", s) for s in (5, 9)], "plate string, well string, channel string, scan long")
    edits = spark.createDataFrame([("p", "A01", "delete", 5, "c1"), ("p", "A01", "add", 9, "c1"), ("p", "A01", "add", 20, "c2")], "plate string, well string, op string, scan long, channel string")
    assert pk.with_edits(peaks, edits).orderBy("scan").toPandas()[["scan", "manual"]].values.tolist() == [[9, False], [20, True]]
    log = [("w", i, op, e) for i, (op, e) in enumerate([("edit", "a"), ("edit", "b"), ("undo", None), ("redo", None), ("undo", None), ("edit", "c"), ("redo", None), ("undo", None), ("undo", None), ("undo", None)])]
    got = ed.folded_edits(spark.createDataFrame(log, "k string, seq int, op string, edit string"), ["k"], "seq").first()
    assert (got["n_standing"], got["last_standing"]) == (0, None)
    got = ed.folded_edits(spark.createDataFrame(log[:7], "k string, seq int, op string, edit string"), ["k"], "seq").first()
    assert (got["n_standing"], got["last_standing"]) == (2, "c")


def test_range_join_equals_its_condition(spark):
    r = np.random.default_rng(3)
    a = spark.createDataFrame([(int(k), int(x)) for k, x in r.integers(0, 60, (40, 2)) % [3, 60]], "k long, x long")
    b = spark.createDataFrame([(int(k), int(y)) for k, y in r.integers(0, 60, (40, 2)) % [3, 60]], "k long, y long")
    want = sorted(a.join(b, "k").where("y BETWEEN x - 7 AND x + 4").select("k", "x", "y").collect())
    got = sorted(jn.range_join(a, b, ["k"], "y", F.col("x") - 7, F.col("x") + 4, 5).select("k", "x", "y").collect())
    assert got == want
    semi = sorted(jn.range_join(a, b, ["k"], "y", F.col("x") - 7, F.col("x") + 4, 5, "left_semi", ["k", "x"]).collect())
    assert semi == sorted(x for x in a.collect() if (x["k"], x["x"]) in {(w["k"], w["x"]) for w in want})
    anti = jn.range_join(a, b, ["k"], "y", F.col("x") - 7, F.col("x") + 4, 5, "left_anti", ["k", "x"]).count()
    assert anti == a.count() - len(semi)


def test_mutant_fraction_vectors(spark):
    rows = []
    for well, areas in {"a": (5, 4, 3, 2), "b": (8, 1), "c": (3, 2), "d": (5, 3, 2), "e": (7,), "f": (0, 0)}.items():
        rows += [("p", well, float(i), 10.0, float(a)) for i, a in enumerate(areas)]
    d = gt.mutant_fraction(spark.createDataFrame(rows, "plate string, well string, scan double, height double, area double")).toPandas().set_index("well")
    assert d["mf"].to_dict() == pytest.approx({"a": 5 / 14, "b": 0.0, "c": 0.4, "d": 0.5, "e": 0.0, "f": 0.0})
    assert d["status"]["f"] == "no signal"


def test_gap_check_marks_the_left_peak(spark):
    d = spark.createDataFrame([("p", "A01", s, "A", 40) for s in (0, 10, 20, 60, 70)], "plate string, well string, scan long, base string, quality int")
    got = bc.gap_check(d).orderBy("scan").toPandas()
    assert got["wide_gap"].tolist() == [False, False, True, False, False] and got["quality"].tolist() == [40, 40, 20, 40, 40]


def test_a_single_call_survives_even_spacing(spark):
    d = spark.createDataFrame([("p", "A01", 3, "A", 40)], "plate string, well string, scan long, base string, quality int")
    assert bc.even_spacing(d).count() == 1


def test_constant_channels_have_no_correlation(spark):
    d = spark.createDataFrame([("p", "A01", i, 5.0, float(i), 1.0, 2.0, 1.0) for i in range(60)], TRACE)
    got = gt.correlations(d).first()
    assert got["corr_c1_c2"] == 0.0


def test_scaled_features_have_median_zero(spark):
    d = spark.createDataFrame([("p", f"w{i}", float(i * i)) for i in range(9)], "plate string, well string, x double")
    got = gt.robust_scale(d, ["x"]).toPandas()["x"]
    assert float(got.median()) == 0.0


def test_plate_names(spark):
    d = spark.createDataFrame([("G_Run1",), ("G_Run12",), ("G",)], "n string").select(gt.plate_name(F.col("n")).alias("n"))
    assert [r["n"] for r in d.collect()] == ["G_Run01", "G_Run12", "G"]


def test_consensus_first_caller_wins_ties(spark):
    d = spark.createDataFrame([(1, 1, "G"), (1, 2, "A"), (1, 3, "A"), (1, 4, "G"), (2, 1, "A"), (3, 1, "A"), (3, 2, "N")], "place long, caller long, base string")
    got = {r["place"]: r["base"] for r in sq.consensus(d, ["place"], "caller").collect()}
    assert got == {1: "G", 3: "N"}


def test_alignment_labels(spark):
    ref = "ACGTTGCAACGGTTCAGTCAAGCTTGCATGCCTGCAGGTCGACTCTAGAGGATCCCCGGG"
    d = spark.createDataFrame([("w", "TT" + ref[3:])], "well string, sequence string")
    a = sq.align(d, ref)
    got = sq.transferred_labels(a).orderBy("position").toPandas()
    assert "".join(got["base"]) == ref[3:] and got["position"].iloc[0] == 2


def test_windows_inside_the_trace_only(spark):
    d = spark.createDataFrame([("p", "A01", i, float(i), 0.0, 0.0, 0.0, 1.0) for i in range(10)], TRACE)
    at = spark.createDataFrame([("p", "A01", s) for s in (1, 2, 7, 8)], "plate string, well string, position long")
    got = sg.windows(d, at, 2, ["c1"]).orderBy("position").toPandas()
    assert got["position"].tolist() == [2, 7] and list(got["x_c1"][0]) == [0, 1, 2, 3, 4]


def test_background_stays_clear_of_peaks(spark):
    d = spark.createDataFrame([("p", "A01", i, 0.0, 0.0, 0.0, 0.0, 1.0) for i in range(30)], TRACE)
    peak = spark.createDataFrame([("p", "A01", 10)], "plate string, well string, scan long")
    got = ln.background(d, peak, 2, 3, 100).orderBy("position").toPandas()
    assert got["position"].tolist() == [2, 3, 4, *range(16, 28)]
    assert ln.background(d, peak, 2, 3, 4).count() == 4


def test_empty_class_weighs_nothing(spark):
    d = spark.createDataFrame([(0,), (0,), (1,)], "y int")
    got = {r["label"]: round(r["weight"], 6) for r in ln.class_weights(d, "y", [0, 1, 2]).collect()}
    assert got == {0: 0.5, 1: 1.0, 2: 0.0}
