"""Plate runs, transforms, trace figures, experiments, long alignments and windows against plain versions and hand vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceforge.functions import kernels as k
from traceforge.operators import experiments as ex
from traceforge.operators import genotype as gt
from traceforge.operators import peaks as pk
from traceforge.operators import runs
from traceforge.operators import sequences as sq
from traceforge.operators import signal as sg
from traceforge.plans import planted
from traceforge.schema import M13_REFERENCE, WELL
from traceforge.sources import folders, sinks

TRACE = "plate string, well string, scan long, c1 double, c2 double, c3 double, c4 double, current double"


def bell(n, *tops):
    x = np.arange(n)
    return sum((h * np.exp(-0.5 * ((x - at) / s) ** 2) for at, h, s in tops), np.zeros(n))


def frame(spark, wells, plate="p", current=None):
    rows = []
    for w, (c2, c3) in wells.items():
        rows += [(plate, w, i, 0.0, float(a), float(b), 0.0, (current or {}).get(w, 1.0)) for i, (a, b) in enumerate(zip(c2, c3))]
    return spark.createDataFrame(rows, TRACE)


N, LOW, HIGH = 700, 100, 650
STANDARD = [(200, 4000, 3), (230, 5000, 3), (400, 4500, 3), (500, 5500, 3)]


def run(spark, wells):
    got = runs.plate_run(frame(spark, wells), LOW, HIGH).toPandas().set_index("well")
    got["at"] = [[round(x) for x in s] for s in got["scans"]]
    return got


def test_a_plate_of_each_kind_of_well(spark):
    std = bell(N, *STANDARD)
    spike = std.copy()
    spike[600] = 30_000  # a scan wide: higher than all standards
    sample = [(190, 9000, 3), (218, 6000, 3), (390, 8000, 3), (490, 5000, 3)]
    wells = {
        "A01": (bell(N, *sample), std),
        "A02": (bell(N, sample[0]), std),
        "A03": (np.zeros(N), std),
        "A04": (bell(N, (130, 9000, 3), *sample[1:]), std),  # a primer: alone before the rest
        "A05": (bell(N, *sample, (340, 8000, 3)), std),  # matches no standard
        "A06": (bell(N, *sample), spike),
        "A07": (bell(N, *sample[:3], (490, 9000, 14)), std),  # a broad one
        "A08": (bell(N, *sample[:2], (285, 5900, 0.6)), std),
        "A09": (bell(N, (176, 7000, 3), (190, 9000, 3), (340, 7000, 3)), std),  # one match alone: all count
        "A10": (bell(N, *sample), bell(N, *STANDARD, (560, 1000, 3))),  # five standards: the tallest four
    }
    got = run(spark, wells)
    assert set(got["grade"]) == {"GOOD"}
    assert got.loc["A01", "at"] == [190, 218, 390, 490] and got.loc["A01", "status"] == "heteroduplex"
    areas = [a * s for _, a, s in sample]
    share = min(areas[0] + areas[1], areas[2] + areas[3]) / sum(areas)
    assert got.loc["A01", "mf"] == pytest.approx(share, rel=0.02)
    nearest = [h * 3 * np.sqrt(2 * np.pi) for _, h, _ in STANDARD]
    inner = [bell(11, (5, h, 3)) for _, h, _ in STANDARD]
    trapezoids = [float(y.sum() - (y[0] + y[-1]) / 2) for y in inner]
    assert nearest[0] > trapezoids[0]
    want = [a * s * np.sqrt(2 * np.pi) / t for (_, a, s), t in zip(sample, trapezoids)]
    assert got.loc["A01", "norm_areas"] == pytest.approx(want, rel=0.03)
    assert (got.loc["A02", "n_peaks"], got.loc["A02", "status"], got.loc["A02", "mf"]) == (1, "homoduplex", 0.0)
    assert (got.loc["A03", "n_peaks"], got.loc["A03", "status"], len(got.loc["A03", "scans"])) == (0, "no peaks", 0)
    assert got.loc["A04", "at"] == [218, 390, 490]
    assert got.loc["A05", "at"] == [190, 218, 390, 490]
    assert got.loc["A06", "norm_areas"] == pytest.approx(got.loc["A01", "norm_areas"], rel=1e-6)
    assert got.loc["A07", "at"] == [190, 218, 390]
    assert got.loc["A08", "at"] == [190, 218]
    assert got.loc["A09", "at"] == [176, 190, 340]
    assert got.loc["A10", "norm_areas"] == pytest.approx(got.loc["A01", "norm_areas"], rel=1e-6)


def test_grades_and_wells_without_standards(spark):
    """Six plates in one run."""
    two = bell(N, (200, 4000, 3), (300, 5000, 3))
    sample = bell(N, (190, 9000, 3))
    wide = lambda s: bell(N, *[(at, h, s) for at, h, _ in STANDARD])
    cases = {"GOOD": bell(N, *STANDARD), "FAILED": two, "FAILED ": np.zeros(N), "FAIR": wide(5.5)}
    d = frame(spark, {"A01": (bell(N, (190, 9000, 8)), wide(8))}, "POOR")
    for grade, std in cases.items():
        d = d.unionByName(frame(spark, {"A01": (sample, std), "A02": (sample, std)}, grade))
    d = d.unionByName(frame(spark, {"A01": (bell(N, (190, 9000, 3), (215, 6000, 3)), np.zeros(N)), "A02": (np.zeros(50), np.zeros(50))}, "none"))
    got = {(r["plate"], r["well"]): r for r in runs.plate_run(d, LOW, HIGH).collect()}
    for (plate, _), r in got.items():
        assert r["grade"] == ("FAILED" if plate == "none" else plate.strip())
    assert [round(x) for x in got["POOR", "A01"]["scans"]] == [190]  # 19 wide passes 25
    none = got["none", "A01"]
    assert [round(x) for x in none["scans"]] == [190, 215] and none["norm_areas"] == [0.0, 0.0] and ("none", "A02") not in got


def test_transforms_in_order(spark):
    """The edge is sought on the normed axis: wells whose peaks differ by their current alone come to lie together."""
    y = bell(400, (200, 5000, 4))
    late = bell(400, (160, 5000, 4))
    d = frame(spark, {"A01": (y, y * 0), "A02": (late, y * 0)}, current={"A01": 1.0, "A02": 1.25})
    by = {}
    for norm, align in ((True, True), (True, False), (False, True), (False, False)):
        t = runs.transformed(d, norm, align).toPandas()
        by[norm, align] = {w: float(p.loc[p["c2"].idxmax(), "scan_pos"]) for w, p in t.groupby("well")}
    mean = 1.125
    assert by[False, False] == {"A01": 200, "A02": 160}
    assert by[True, False] == pytest.approx({"A01": 200 / mean, "A02": 160 * 1.25 / mean})
    edge = {w: x for w, x in by[True, True].items()}
    # Left edges differ by the scaled half width alone, so the tops stay apart by a tenth of it, not by tens of scans.
    assert abs(edge["A01"] - edge["A02"]) < 4 and abs(by[False, True]["A01"] - by[False, True]["A02"]) < 0.5
    assert {"d1", "d4"} <= set(runs.transformed(d, matrix=np.eye(4)).columns)


def test_trace_figures_on_a_hand_vector(spark):
    y = bell(700, (300, 1000, 3), (500, 400, 6))
    d = frame(spark, {"A01": (y, y * 0), "A02": (y * 0, y * 0)})
    got = gt.trace_peak_stats(sg.to_long(d, ["c2"])).toPandas().set_index("well")
    r = got.loc["A01"]
    assert (r.n_peaks, r.first_scan, r.last_scan, r.spread) == (2, 300, 500, 200)
    assert (r.mean_height, r.max_height, r.sum_height) == (700, 1000, 1400) and r.mean_prominence == pytest.approx(700, rel=1e-3)
    assert r.mean_width == pytest.approx(2.3548 * 4.5, rel=0.02)
    assert got.loc["A02"].drop(["plate", "channel"]).eq(0).all()
    reg = gt.region_features(sg.to_long(d, ["c2"]), 280, 320).toPandas()
    assert reg[["mean", "n_peaks"]].eq(0).all().all()
    reg = gt.region_features(sg.to_long(d, ["c2"]), 250, 400).toPandas().set_index("well").loc["A01"]
    assert reg.n_peaks == 1 and reg["max"] == 1000 and reg["energy"] == pytest.approx((y[250:400] ** 2).sum())


def test_standards_without_help(spark):
    rng = np.random.default_rng(0)
    c3 = bell(800, (300, 2000, 4), (400, 1500, 4), (500, 1800, 4), (600, 900, 4)) + rng.normal(0, 3, 800)
    c2 = bell(800, (400, 1000, 4), (500, 8, 4))
    d = frame(spark, {"A01": (c2, c3), "A02": (c2, rng.normal(0, 3, 800))})
    found = gt.automatic_standards(d).orderBy("scan").toPandas()
    assert [round(x, -1) for x in found["scan"]] == [300, 500, 600] and (found["ratio"] == 999).all()
    f = gt.standard_figures(d, gt.automatic_standards(d)).toPandas().set_index("well")
    assert (f.loc["A01", "is_n_peaks"], f.loc["A02", "is_n_peaks"], f.loc["A01", "is_peak_4_scan"]) == (3, 0, 0) and f.loc["A01", "is_spread"] == found["scan"].max() - found["scan"].min()


def plain_alignment(query, ref):
    n, m = len(query), len(ref)
    s, t = np.zeros((n + 1, m + 1), int), np.zeros((n + 1, m + 1), int)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            o = [0, s[i - 1, j - 1] + (2 if query[i - 1] == ref[j - 1] else -3), s[i - 1, j] + (-1 if t[i - 1, j] == 2 else -10), s[i, j - 1] + (-1 if t[i, j - 1] == 3 else -10)]
            t[i, j], s[i, j] = int(np.argmax(o)), max(o)
    i, j = divmod(int(s.argmax()), m + 1)
    end, q, r = (int(s[i, j]), i, j), [], []
    while i and j and t[i, j]:
        q.append(query[i - 1] if t[i, j] != 3 else "-")
        r.append(ref[j - 1] if t[i, j] != 2 else "-")
        i, j = i - (t[i, j] != 3), j - (t[i, j] != 2)
    return (*end, i, j, "".join(q[::-1]), "".join(r[::-1]))


def test_alignments_against_the_whole_table():
    r = random.Random(3)
    for _ in range(60):
        ref = "".join(r.choice("ACGT") for _ in range(r.randint(0, 70)))
        query = list(ref[r.randint(0, 10) :]) if r.random() < 0.7 else [r.choice("ACG") for _ in range(r.randint(0, 90))]
        for _ in range(r.randint(0, 6)):
            if query:
                at = r.randrange(len(query))
                query[at : at + r.randint(0, 9)] = [r.choice("ACGT") for _ in range(r.randint(0, 2))]
        got = k.align_local("".join(query), ref)
        assert (got["score"], got["query_end"], got["ref_end"], got["query_start"], got["ref_start"], got["query_line"], got["ref_line"]) == plain_alignment("".join(query), ref)


def test_a_long_text_aligns_in_little_memory():
    import tracemalloc

    r = random.Random(1)
    noise = "".join(r.choice("ACGT") for _ in range(60_000))
    query = noise[:10_000] + M13_REFERENCE[100:700] + noise[10_000:20_000]
    tracemalloc.start()
    got = k.align_local(query, M13_REFERENCE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["query_start"] <= 10_000 <= got["query_start"] + 40 and got["matches"] >= 600 and got["score"] >= 1200
    assert peak < 12e6 < 5 * len(query) * len(M13_REFERENCE)


def test_windows_are_slices(spark):
    r = random.Random(2)
    y = {w: np.array([[r.random() for _ in range(4)] for _ in range(n)]) for w, n in (("A01", 40), ("A02", 5), ("A03", 11))}
    d = spark.createDataFrame([("p", w, i, *map(float, a), 1.0) for w, m in y.items() for i, a in enumerate(m)], TRACE).repartition(3)
    at = [("p", w, int(p), f"tag{n}") for n, (w, p) in enumerate([("A01", 5), ("A01", 5), ("A01", 4), ("A01", 34), ("A01", 35), ("A02", 2), ("A03", 5), ("A09", 5)])]
    d2 = sg.windows(d, spark.createDataFrame(at, "plate string, well string, position long, tag string"), 5, ["c1", "c3"])
    assert d2.columns == [*WELL, "position", "tag", "x_c1", "x_c3"] and "Window" not in d2._jdf.queryExecution().executedPlan().toString()
    got = {x["tag"]: (x["x_c1"], x["x_c3"]) for x in d2.collect()}
    want = {t: (y[w][p - 5 : p + 6, 0].tolist(), y[w][p - 5 : p + 6, 2].tolist()) for _, w, p, t in at if w in y and 5 <= p < len(y[w]) - 5}
    assert got == want and set(want) == {"tag0", "tag1", "tag3", "tag6"}


def test_top_widths(spark):
    y = bell(200, (60, 100, 3), (150, 50, 4))
    y[100] = 500
    d = frame(spark, {"A01": (y, y * 0)})
    long = sg.to_long(d, ["c2"])
    at = long.where(F.col("scan").isin(60, 100, 150)).withColumnRenamed("y", "height")
    got = {r["scan"]: r["top_width"] for r in pk.top_widths(long, at, 20, 19).collect()}
    for s in (60, 100, 150):
        part = y[s - 20 : s + 20]
        assert got[s] == pytest.approx(k.widths(part, np.array([part.argmax()]), 0.5)[0][0])


def test_experiments_agree(spark):
    rows, features = planted.planted_features(spark, "/root/testdata/sf0.01")
    rows = rows.persist()
    level = [f for f in features if f.startswith(("c1_", "c2_")) and f.endswith(("mean", "std", "max"))]
    few = [c for c in ex.base_grid(level, features) if c.name in ("logistic_level_0.01", "logistic_level_0.1", "forest_level_3")]
    one = ex.run_grid(rows, "label", WELL, few).collect()
    two = ex.run_grid(rows.repartition(7), "label", WELL, few[1::-1]).collect()
    assert [r["config"] for r in one] == [c.name for c in few] and len({r["test_rows"] for r in one}) == 1
    key = lambda rs: sorted((r["config"], round(r["cv_accuracy"], 6)) for r in rs if r["learner"] == "logistic")
    assert key(one) == key(two)
    assert all(0.34 < r["cv_accuracy"] <= 1 and 0 <= r["test_accuracy"] <= 1 for r in one)
    assert len(ex.base_grid(["a"], ["a", "b"])) == 12 == len({c.name for c in ex.base_grid(["a"], ["a", "b"])})
    with pytest.raises(ValueError):
        ex.run_grid(rows, "label", WELL, [ex.Config("x", "network", tuple(features[:2]))])


def test_reference_text(spark):
    assert len(M13_REFERENCE) == 821 and set(M13_REFERENCE) == set("ACGT")
    path = folders.work_folder(spark, "reference")
    sinks.write_reference(spark, path)
    assert [r["value"] for r in spark.read.text(path).collect()] == [M13_REFERENCE]
    d = spark.createDataFrame([("a", M13_REFERENCE[50:600]), ("b", None)], "k string, sequence string")
    got = {r["k"]: (r["identity"], r["ref_start"]) for r in sq.align(d, M13_REFERENCE).collect()}
    assert got == {"a": (1.0, 50), "b": (0.0, 0)}
