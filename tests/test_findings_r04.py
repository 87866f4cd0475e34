"""What the findings of round 4 asked for."""

from __future__ import annotations

import numpy as np
import pytest

from traceforge.functions import kernels as k
from traceforge.operators import peaks as pk
from traceforge.operators import runs
from traceforge.operators import signal as sg
from traceforge.operators import standards as sd
from traceforge.plans import views as v


def test_fits_of_crowded_bells_settle():
    r = np.random.default_rng(4)
    x = np.arange(600.0)
    for _ in range(3):
        y = np.convolve(r.uniform(0, 1000, 620), np.ones(11) / 11, "same")[10:610]
        at = np.sort(r.choice(np.arange(5, 595, 4), 25, False)).astype(float)
        start = np.stack([y[at.astype(int)], at, np.full(25, 3.0)], axis=1)
        got, longer = k.fit_gaussians(x, y, start), k.fit_gaussians(x, y, start, 2000)
        assert np.array_equal(got, longer)
        low, high = np.array([0, 0, 0.5]), np.array([2 * y.max(), 599, 10])
        assert ((got >= low) & (got <= high)).all()
        # No number can be moved alone to fit better.
        cost = lambda q: ((y - (q[:, 0] * np.exp(-0.5 * ((x[:, None] - q[:, 1]) / q[:, 2]) ** 2)).sum(axis=1)) ** 2).sum()  # noqa: B023, E731
        for i in range(25):
            for c, by in enumerate((0.1, 1e-3, 1e-3)):
                for sign in (-by, by):
                    moved = got.copy()
                    moved[i, c] = np.clip(moved[i, c] + sign, low[c], high[c])
                    assert cost(moved) >= cost(got) * (1 - 1e-7)


@pytest.mark.parametrize("smooth", [None, 11])
def test_streamed_groups_are_those_of_the_windows(spark, sf, smooth):
    long = v.long(spark, sf, ("c1", "c2"))
    d = sg.smooth(long, smooth).withColumn("y", sg.F.col("smooth")).drop("smooth") if smooth else long
    by = [*pk.BY_CHANNEL, "scan"]
    want, got = pk.threshold_groups(d, 0.15, 6).orderBy(*by).toPandas(), pk.found_groups(long, 0.15, 6, smooth=smooth).orderBy(*by).toPandas()
    assert len(want) > 20 and (got[by + ["left", "right", "n_points"]] == want[by + ["left", "right", "n_points"]]).all().all()
    assert np.allclose(got[["height", "area"]], want[["height", "area"]], rtol=1e-9)


def test_top_widths_do_not_depend_on_their_place():
    r = np.random.default_rng(5)
    y = r.integers(1, 51, 20_000) * 1000.0
    begin = np.sort(r.integers(0, 19_900, 500))
    end = begin + r.integers(20, 60, 500)
    want = [float(k.widths(y[i:j], np.array([int(np.argmax(y[i:j]))]), 0.5)[0][0]) for i, j in zip(begin, end)]
    assert k.top_widths(y, begin, end).tolist() == want


def test_half_widths_by_walks():
    r = np.random.default_rng(6)
    y = r.integers(0, 50, 900).astype(float)
    bounds = np.array([0, 300, 303, 900])
    at = np.flatnonzero(y > 40)
    trace = np.searchsorted(bounds, at, "right") - 1
    left, right = k.half_widths(y, at, y[at], bounds[trace], bounds[trace + 1])
    for p, t, i, j in zip(at, trace, left, right):
        a, b = p - 1, p + 1
        while a >= bounds[t] and y[a] > y[p] / 2:
            a -= 1
        while b < bounds[t + 1] and y[b] > y[p] / 2:
            b += 1
        assert (i, j) == (max(a, bounds[t]), min(b, bounds[t + 1] - 1))


def test_a_plate_run_takes_no_range_join_or_row_walk(spark):
    """Widths and groups come from one pass over many traces at a time: none is a join or fold that Spark works out row by row."""
    trace = v.trace(spark, "/root/testdata/sf0.001")
    plan = runs.plate_run(trace, 100, 500)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" not in plan and "_m4096" not in plan and "FlatMapCoGroupsInPandas" not in plan


def test_candidates_meet_wells_and_not_a_plates_peaks(spark):
    r = np.random.default_rng(7)
    rows = [(p, f"w{w:02d}", int(s), float(r.integers(1, 9)), float(r.integers(0, 3))) for p, wells in (("a", 7), ("b", 5), ("c", 1)) for w in range(wells) for s in np.unique(r.integers(0, 400, 30))]
    rows.append(("d", "w00", 3, 1.0, 1.0))  # nothing after the first scans
    peaks = spark.createDataFrame(rows, "plate string, well string, scan long, height double, quality double").repartition(5)
    d = sd.consistent_candidates(peaks, first_scan=20, most=12, within=25, share=0.5, spread=12)
    want = {}
    for plate in "abcd":
        of = {}
        for p, w, s, h, q in rows:
            if p == plate:
                of.setdefault(w, []).append((s, h, q))
        for ref, _, q in sorted((x for x in of[min(of)] if x[0] >= 20), key=lambda x: (-x[1], x[0]))[:12]:
            best = [min((abs(s - ref), s) for s, _, _ in x) for x in of.values()]
            at = [s for far, s in best if far <= 25]
            if len(at) >= max(4, len(of) // 2) and np.std(at) <= 12 and q > 0:
                want[plate, ref] = (len(at), np.std(at), q / max(np.std(at), 0.1))
    got = {(x["plate"], x["scan"]): (x["n_wells"], x["std_scan"], x["score"]) for x in d.collect()}
    assert got.keys() == want.keys() and len(want) > 5 and all(got[key] == pytest.approx(want[key]) for key in want)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "_bucket" not in plan


def test_streamed_groups_split_like_given_ones(spark):
    long = v.long(spark, "/root/testdata/sf0.001", ("c1", "c2"))
    by = [*pk.BY_CHANNEL, "scan"]
    want = pk.split_broad(long, pk.threshold_groups(long, 0.1, 15), 50, 5).orderBy(*by).toPandas()
    got = pk.found_groups(long, 0.1, 15, split=(50, 5)).orderBy(*by).toPandas()
    assert (want["n_parts"] > 1).any() and (got[by] == want[by]).all().all() and np.allclose(got[["height", "area"]], want[["height", "area"]])
    plan = runs.duplex_wells(v.trace(spark, "/root/testdata/sf0.001"), 100, 500)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" not in plan and plan.count("FlatMapCoGroupsInArrow") == 2  # the fit, for its two readers
