"""Training windows, references, classifiers, dispatch and name matching on hand vectors; queries without SQL against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceforge.operators import basecall as bc
from traceforge.operators import genotype as gt
from traceforge.operators import joins as jn
from traceforge.operators import learning as ln
from traceforge.operators import peaks as pk
from traceforge.operators import runs
from traceforge.operators import signal as sg
from traceforge.operators import standards as sd
from traceforge.operators import training as tn
from traceforge.plans import registry
from traceforge.plans import views as v
from traceforge.schema import SPECTRAL_MATRIX
from traceforge.sources import sinks, tables

TRACE = "plate string, well string, scan long, c1 double, c2 double, c3 double, c4 double, current double"
CALLS = "plate string, well string, position double, base string, quality double"
AT = "plate string, well string, scan long"


def bell(x, at, height, width=3.0):
    return height * np.exp(-0.5 * ((x - at) / width) ** 2)


def frame(spark, wells, plate="p"):
    return spark.createDataFrame([(plate, w, int(i), *map(float, r), 1.0) for w, y in wells.items() for i, r in enumerate(y)], TRACE)


def flat(spark, n=40):
    return frame(spark, {"A01": np.stack([np.arange(n), np.zeros(n), np.zeros(n), np.zeros(n)], axis=1)})


def test_names_match_by_prefix_and_containment(spark):
    wanted = [("OYIL4",), ("CYBA",), ("G_Run1",), ("G_Run2",), ("long_name_Run1",), ("nothing",), ("IL10_Run1",)]
    folders = [("OYIL4R_160910",), ("xCYBAy_1",), ("G_Run01",), ("G_Run2",), ("G_Run02",), ("name",), ("IL10_Run01_b",), ("aIL10_Run01",)]
    got = gt.match_names(spark.createDataFrame(wanted, "wanted string"), spark.createDataFrame(folders, "folder string"))
    assert {r["wanted"]: (r["folder"], r["how"]) for r in got.collect()} == {
        "OYIL4": ("OYIL4R_160910", 2), "CYBA": ("xCYBAy_1", 3), "G_Run1": ("G_Run01", 1), "G_Run2": ("G_Run2", 0), "long_name_Run1": ("name", 3), "IL10_Run1": ("IL10_Run01_b", 2),
    }


def test_wells_align_by_the_left_edge_of_the_tallest_peak(spark):
    x, z = np.arange(200), np.zeros(200)
    places = {"A01": (50, 120), "A02": (60, 90), "A03": (80, 30)}
    wells = {w: np.stack([bell(x, a, 900), bell(x, b, 500), z, z], axis=1) for w, (a, b) in places.items()} | {"A04": np.zeros((200, 4))}
    trace = frame(spark, wells)
    peaks = pk.detect_default(sg.to_long(trace, ["c1", "c2", "c3", "c4"]))
    shift = {r["well"]: r["shift"] for r in sg.align_to_left_edge(trace, peaks).select("well", "shift").distinct().collect()}
    assert shift == pytest.approx({"A01": 10.0, "A02": 0.0, "A03": -20.0, "A04": 0.0}, abs=1e-6)
    scaled = trace.withColumn("scan", F.col("scan")).withColumn("at", F.col("scan") * 2.0)
    twice = {r["well"]: r["shift"] for r in sg.align_to_left_edge(scaled, peaks, "at").select("well", "shift").distinct().collect()}
    assert twice["A01"] == pytest.approx(20.0) and twice["A03"] == pytest.approx(-40.0)


def test_training_windows_and_labels(spark):
    calls = spark.createDataFrame([("p", "A01", s, b, 9.0) for s, b in ((2.9, "A"), (5.0, "C"), (5.0, "x"), (37.0, "G"), (38.0, "T"))], CALLS)
    got = tn.training_windows(flat(spark), calls, 2, ["c1"]).orderBy("position", "label").toPandas()
    assert got["position"].tolist() == [2, 5, 5, 37] and got["label"].tolist() == [0, 1, 4, 2] and list(got["x_c1"][0]) == [0, 1, 2, 3, 4]
    low = spark.createDataFrame([("p", "A01", 1.0, b, q) for b, q in (("a", 10.0), ("N", 50.0), ("T", 9.9), (None, 99.0))], CALLS)
    assert [r["base"] for r in tn.good_calls(low).collect()] == ["a"]


def test_calls_move_to_near_peaks(spark):
    calls = spark.createDataFrame([("p", "A01", 10.0, "A", 1.0), ("p", "A01", 20.0, "C", 1.0), ("p", "A01", 30.0, "G", 1.0), ("p", "B01", 5.0, "T", 1.0)], CALLS)
    peaks = spark.createDataFrame([("p", "A01", 7), ("p", "A01", 13), ("p", "A01", 26)], AT)
    m = tn.matched_calls(calls, peaks, 5)
    got = {(r["well"], r["called_at"]): (r["position"], r["matched"], r["offset"]) for r in m.collect()}
    assert got == {("A01", 10): (7, True, -3), ("A01", 20): (20, False, None), ("A01", 30): (26, True, -4), ("B01", 5): (5, None, None)}
    a = tn.match_stats(m).where("well = 'A01'").first()
    assert (a["matched"], a["unmatched"], a["avg_offset"], a["std_offset"]) == (2, 1, -3.5, 0.5)
    assert tn.matched_windows(flat(spark), calls, peaks, 2, 5, ["c1"]).count() == 3


def test_accuracy_under_shifts(spark):
    y = np.ones((60, 4))
    for i, at in enumerate((10, 20, 30, 40)):
        y[at, i] = 100.0
    calls = spark.createDataFrame([("p", "A01", float(s), b, 9.0) for s, b in zip((10, 20, 30, 40), "ACGT")], CALLS)
    windows = tn.training_windows(frame(spark, {"A01": y}), calls, 5)

    def scorer(x):
        return np.eye(4)[x[:, x.shape[1] // 2, :].argmax(axis=1)]

    got = {r["shift"]: (r["n"], r["accuracy"]) for r in tn.shift_accuracy(windows, scorer, (0, 2)).collect()}
    assert got[0] == (4, 1.0) and got[2][0] == 4 and got[2][1] < 0.5


def test_discriminants_against_plain_scatter(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(m, (1, 2, 0.5), (50, 3)) for m in ((0, 0, 0), (3, 1, 0), (0, 2, 1))])
    y = np.repeat([0, 1, 2], 50)
    d = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(y, x)], "y int, a double, b double, c double")
    within = sum((x[y == k] - x[y == k].mean(0)).T @ (x[y == k] - x[y == k].mean(0)) for k in range(3))
    between = sum(50 * np.outer(x[y == k].mean(0) - x.mean(0), x[y == k].mean(0) - x.mean(0)) for k in range(3))
    got = ln.discriminants(d, "y", ["a", "b", "c"], 2)
    for i, value in enumerate(sorted(np.linalg.eigvals(np.linalg.pinv(within) @ between).real)[:0:-1]):
        assert np.allclose(np.linalg.pinv(within) @ between @ got[:, i], value * got[:, i], atol=1e-8)
    many = spark.createDataFrame([(i, float(i), 1.0) for i in range(3000)], "y int, a double, b double")
    s = tn.discriminant_sums(many, "y", ["a", "b"]).first()
    assert s["w_0_0"] == pytest.approx(0.0, abs=1e-3) and s["b_0_0"] == pytest.approx(np.var(np.arange(3000)) * 3000)


def test_farthest_spread(spark):
    rows = [("p", 100, 9.0), ("p", 110, 8.0), ("p", 400, 5.0), ("p", 250, 4.0), ("p", 260, 1.0), ("q", 5, 3.0), ("q", 6, 2.0)]
    got = sd.farthest_spread(spark.createDataFrame(rows, "plate string, scan long, score double")).orderBy("ref_idx").collect()
    assert [(r["plate"], r["ref_scan"]) for r in got] == [("p", 100), ("p", 250), ("p", 260), ("p", 400)] or [(r["plate"], r["ref_scan"]) for r in got] == [("p", 100), ("p", 250), ("p", 400)]


def test_plate_references_fall_back(spark):
    rows = [("a", s, 5.0) for s in (100, 150, 200, 260)] + [("b", 10, 50.0), ("b", 12, 40.0), ("b", 60, 30.0), ("b", 100, 20.0)] + [("c", 10, 1.0)]
    manual = spark.createDataFrame([(p, 1, 77) for p in "abcd"], "plate string, ref_idx long, ref_scan long")
    got = sd.plate_references(spark.createDataFrame(rows, "plate string, scan long, score double"), manual).orderBy("plate", "ref_idx").collect()
    by = {}
    for r in got:
        by.setdefault((r["plate"], r["how"]), []).append(r["ref_scan"])
    assert by[("a", "pattern")] == [100, 150, 200, 260] and by[("c", "manual")] == [77] and by[("d", "manual")] == [77]
    assert by[("b", "spread")] == sorted(by[("b", "spread")]) and {10, 100} <= set(by[("b", "spread")])


def test_greedy_references(spark):
    refs = spark.createDataFrame([("p", 1, 100), ("p", 2, 105), ("p", 3, 500), ("p", 4, 900)], "plate string, ref_idx long, ref_scan long")
    peaks = spark.createDataFrame([("p", "A01", s) for s in (90, 110, 260, 650, 1051)] + [("p", "A01", 110)], AT)
    got = sd.greedy_references(refs, peaks).orderBy("ref_idx").collect()
    assert [(r["ref_idx"], r["scan"]) for r in got] == [(1, 90), (2, 110), (3, 650)]


def test_examples_and_best_scored(spark):
    features = spark.createDataFrame([("p", w, s, float(s)) for w in ("A01", "A02") for s in range(20)], "plate string, well string, scan long, x double")
    marked = spark.createDataFrame([("p", "A01", s) for s in (5, 9)] + [("p", "A02", 5)], AT)
    got = sd.standard_examples(features, features.select("plate", "well", "scan"), marked, 2).orderBy("scan").collect()
    assert [(r["scan"], r["label"]) for r in got] == [(0, 0), (1, 0), (2, 0), (3, 0), (5, 1), (9, 1)]
    best = sd.best_scored(features.withColumnRenamed("x", "score").where("scan < 6"), 2).orderBy("well", "scan").collect()
    assert [(r["scan"], r["idx"]) for r in best] == [(4, 1), (5, 2)] * 2


def test_calls_by_the_name_of_a_chemistry(spark):
    x = np.arange(120)
    pure = np.stack([bell(x, a, 900) for a in (20, 45, 70, 95)], axis=1)
    trace = frame(spark, {"A01": pure @ np.array(SPECTRAL_MATRIX).T})
    for name, bases in (("ET Primers", "ACTG"), ("TSII-v2", "AGCT")):
        got = bc.call_bases(frame(spark, {"A01": pure}), name, detect=lambda t: pk.detect_for_bases(t, (0, 0, 0, 0), 100, 50)).orderBy("position").toPandas()
        assert "".join(got["base"]) == bases and (got["quality"] > 90).all()
    for name in ("Cimarron 3.12", "Cimarron 3.12 and Aligned", "Cimarron 3.12 Even Spacing"):
        got = bc.call_bases(trace, name, detect=lambda t: pk.detect_for_bases(t, (0, 0, 0, 0), 300, 200)).orderBy("position").toPandas()
        assert "".join(got["base"]).replace("N", "") == "TGCA"
    with pytest.raises(ValueError):
        bc.call_bases(trace, "unknown")


def test_standard_only_calls_without_labels(spark):
    f = spark.createDataFrame([("p", f"w{i}", float(i)) for i in range(6)], "plate string, well string, x double")
    few = spark.createDataFrame([("p", "w1", 1)], "plate string, well string, label int")
    assert {(r["prediction_name"], r["confidence"]) for r in gt.standard_only_calls(f, few, ["x"]).collect()} == {("het", 0.0)}


def test_plate_run(spark):
    x, z = np.arange(600), np.zeros(600)
    wells = {f"A{i:02d}": np.stack([z, bell(x, 200, 300) + bell(x, 250, 200), bell(x, 230, 500) + bell(x, 300, 400) + bell(x, 400, 450), z], axis=1) for i in range(1, 4)}
    got = runs.plate_run(frame(spark, wells | {"B01": np.zeros((600, 4))}, "q"), 100, 500).toPandas().set_index("well")
    assert set(got["grade"]) == {"FAILED"}  # nine standard peaks in four wells
    got = runs.plate_run(frame(spark, wells), 100, 500).toPandas().set_index("well")
    a = got.loc["A01"]
    assert a["grade"] == "GOOD" and a["n_peaks"] == 2 and a["status"] == "partial" and a["mf"] == pytest.approx(0.4, abs=0.02)
    assert list(a["scans"]) == [200, 250] and a["norm_areas"][0] == pytest.approx(0.6, abs=0.05) and a["norm_areas"][1] == pytest.approx(0.4, abs=0.05)


def test_picks_and_prefixes(spark):
    peaks = spark.createDataFrame([("p", "A01", "c1", s, 1.0) for s in (10, 14, 40)], "plate string, well string, channel string, scan long, height double")
    clicks = spark.createDataFrame([("p", "A01", 12), ("p", "A01", 30), ("p", "A01", 31)], "plate string, well string, at long")
    assert {r["at"]: r["scan"] for r in pk.picked(clicks, peaks).collect()} == {12: 10, 31: 40}
    names = spark.createDataFrame([("OY_IL4",), ("OY_IL10",), ("XY",)], "plate string")
    assert tables.plates_like(names, "OY_IL").count() == 2


def test_sinks_round_trip(spark, tmp_path):
    calls = spark.createDataFrame([("p", "A01", float(s), b, 9.0) for s, b in ((5.0, "C"), (8.0, "G"))], CALLS)
    w = tn.training_windows(flat(spark), calls, 2, ["c1"]).withColumn("variant", F.lit("v1"))
    sinks.write_windows(w, f"{tmp_path}/w")
    back = spark.read.parquet(f"{tmp_path}/w").orderBy("position").collect()
    assert [(r["variant"], r["position"], list(r["x_c1"])) for r in back] == [("v1", 5, [3, 4, 5, 6, 7]), ("v1", 8, [6, 7, 8, 9, 10])]
    sinks.write_csv(calls, f"{tmp_path}/c", ["position"])
    assert [r["base"] for r in spark.read.option("header", "true").csv(f"{tmp_path}/c").collect()] == ["C", "G"]
    results = spark.createDataFrame([("A01", 2, 0.25, "partial", [200.4, 250.5], [0.615, 0.4])], "well string, n_peaks long, mf double, status string, scans array<double>, areas array<double>")
    lines = [r["value"] for r in sinks.plate_lines(results, "P", "T1", "GOOD", 10, 7.0, 6.5, 3.7).collect()]
    assert lines[:2] == ["# Plate,P,T1,Quality,GOOD,FWHM_MAX,10", "# IS_median_FWHM,7.0,Samp_median_FWHM,6.5,IS_per_well,3.7"] and lines[3].startswith("A01,2,0.2500,partial,200")
    refs = spark.createDataFrame([("g", 1, 5), ("h", 1, 6)], "gene string, ref_idx long, ref_scan long")
    new = spark.createDataFrame([("g", 1, 9)], "gene string, ref_idx long, ref_scan long")
    assert {(r["gene"], r["ref_scan"]) for r in sinks.upserted_references(refs, new).collect()} == {("g", 9), ("h", 6)}
    assert [r["value"] for r in sinks.evaluation_json(new).collect()] == ['{"gene":"g","ref_idx":1,"ref_scan":9}']
    dense = sinks.dense_standards(spark.createDataFrame([("f", "A01", 1, 10, 2.0), ("f", "A01", 2, 20, 3.0)], "folder string, well string, is_idx int, scan long, height double"))
    r = dense.first()
    assert (r["is_peak_1_scan"], r["is_peak_2_height"], r["is_peak_4_scan"]) == (10, 3.0, None)


@pytest.fixture(scope="module")
def c2c3(spark, sf):
    std = pk.top_peaks(v.peaks(spark, sf, ("c3",)), 4).toPandas()
    return std, v.peaks(spark, sf, ("c2",)).toPandas()


def test_match_samples_against_a_plain_walk(spark, sf, c2c3):
    std, smp = c2c3
    want = set()
    for well, s in std.groupby("well"):
        free = sorted(smp[smp["well"] == well]["scan"])
        for at in sorted(s["scan"]):
            near = [x for x in free if 5 <= at - x <= 25]
            if near:
                free.remove(max(near))
                want.add((well, at, max(near)))
    assert {(r["well"], r["standard_scan"], r["scan"]) for r in registry.queries()["match_samples"](spark, sf).collect()} == want


def test_edit_log_against_two_stacks(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").toPandas()
    want = {}
    for user, d in events.groupby("user_id"):
        done, undone = [], []
        d = d.assign(op=d["event_type"].map({"error": "undo", "signup": "redo"}).fillna("edit"), edit=d["event_id"].astype(str)).sort_values(["ts", "op", "edit"])
        for op, edit in zip(d["op"], d["edit"]):
            if op == "edit":
                done.append(edit)
                undone = []
            elif op == "undo" and done:
                undone.append(done.pop())
            elif op == "redo" and undone:
                done.append(undone.pop())
        want[user] = (len(done), done[-1] if done else None)
    assert {r["user_id"]: (r["n_standing"], r["last_standing"]) for r in registry.queries()["edit_log_fold"](spark, sf).collect()} == want


def test_model_calls_against_plain_windows(spark, sf):
    t = v.trace(spark, sf).toPandas().sort_values(["well", "scan"])
    got = registry.queries()["model_calls"](spark, sf).toPandas()
    for well, d in got.groupby("well"):
        y = t[t["well"] == well][["c1", "c2", "c3", "c4"]].to_numpy()
        for r in d.itertuples():
            x = y[r.position - 15 : r.position + 16]
            z = ((x - x.mean(0)) / (x.std(0) + 1e-8))[15]
            p = np.exp(z) / np.exp(z).sum()
            assert r.base == "ACGT"[p.argmax()] and r.probability == pytest.approx(p.max())


def test_spikes_and_walks_hold_their_rules(spark, sf):
    spikes = registry.queries()["spike_filter"](spark, sf).toPandas()
    every = v.peaks(spark, sf).toPandas()
    assert (spikes["fwhm"] >= 2.5).all() and 0 < len(spikes) < len(every)
    assert set(map(tuple, spikes[["well", "scan"]].values)) <= set(map(tuple, every[["well", "scan"]].values))
    walk = registry.queries()["spacing_walk"](spark, sf).toPandas()
    for _, d in walk.groupby("well"):
        gaps = np.diff(d.sort_values("idx")["scan"])
        assert len(d) >= 3 and (np.abs(gaps - np.array([100, 120, 100])[: len(gaps)]) <= 30).all()


def test_suppressed_peaks_stand_apart(spark, sf):
    got = registry.queries()["nms_peaks"](spark, sf).toPandas()
    for _, d in got.groupby("well"):
        assert (np.diff(np.sort(d["scan"])) >= 5).all() and (d["height"] >= 15).all()


def test_anti_join_by_keys_is_that_by_rows(spark):
    a = spark.createDataFrame([("p", s, float(s)) for s in (1, 5, 5, 30)], "g string, at long, y double")
    b = spark.createDataFrame([("p", 6), ("q", 1)], "g string, place long")
    for how in ("left_anti", "left_semi"):
        by_rows, by_keys = (jn.range_join(a, b, ["g"], "place", F.col("at") - 2, F.col("at") + 2, 4, how, keys) for keys in (None, ["g", "at"]))
        assert sorted(r["at"] for r in by_rows.collect()) == sorted(r["at"] for r in by_keys.collect()) == ([1, 30] if how == "left_anti" else [5, 5])


def test_separation_undoes_emission(spark):
    m = np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.6, 0.2, 0.1], [0.0, 0.1, 0.8, 0.1], [0.2, 0.1, 0.1, 0.6]])
    d = spark.createDataFrame([(b, *map(float, 50 * row)) for b, row in zip("ACGT", m)], "base string, c1 double, c2 double, c3 double, c4 double")
    assert np.allclose(ln.separation(ln.emission(d)) @ m.T, np.eye(4))
    assert ln.separation(ln.emission(d.where("base < 'G'"))) is None


def test_thinning_keeps_the_tallest(spark):
    d = spark.createDataFrame([("p", "A01", "c1", s, h) for s, h in ((10, 5.0), (12, 9.0), (15, 4.0), (30, 1.0))], "plate string, well string, channel string, scan long, height double")
    assert sorted(r["scan"] for r in pk.suppress_near(d, 5).collect()) == [12, 30]


def test_a_perceptron_learns_apart_windows(spark):
    from pyspark.ml.functions import array_to_vector

    d = spark.createDataFrame([(float(i % 2), [float(i % 2), 1.0 - i % 2, 0.5]) for i in range(40)], "y double, a array<double>").withColumn("x", array_to_vector("a"))
    model = ln.window_classifier(d, "y", "x", [3, 4, 2])
    assert model.transform(d).where("prediction = y").count() == 40


def test_settings_and_chromatograms(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"a": 2, "new": 3}')
    assert tables.settings(str(tmp_path / "s.json"), {"a": 1, "b": 5}) == {"a": 2, "b": 5, "new": 3} and tables.settings(str(tmp_path / "none"), {"a": 1}) == {"a": 1}
    (tmp_path / "run.arw").write_bytes("0.0\t1.5\n0.1\t2.5\n".encode("utf-16"))
    got = tables.read_chromatograms(spark, str(tmp_path / "run.arw")).orderBy("point").collect()
    assert [(r["name"], r["point"], r["y"]) for r in got] == [("run", 0, 1.5), ("run", 1, 2.5)]
