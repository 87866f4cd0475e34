"""Sequential kernels on hand vectors and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from traceforge.functions import kernels as k
from traceforge.functions.stencils import fit_rows
from traceforge.operators.signal import als_curve


def test_local_maxima_plateaus_and_ends():
    assert k.local_maxima(np.array([0, 1, 0, 2, 2, 2, 1, 3])).tolist() == [1, 4]
    assert k.local_maxima(np.array([1, 1, 1])).tolist() == []
    assert k.local_maxima(np.array([])).tolist() == []
    assert k.local_maxima(np.array([5, 1])).tolist() == []


def test_distance_before_prominence_and_equal_heights():
    y = np.array([0, 5, 4.9, 6, 0, 0, 3, 0, 3, 0], float)
    assert k.find_peaks(y, distance=3).tolist() == [3, 8]  # of the equal peaks at 6 and 8 the later stays
    assert k.find_peaks(y, prominence=1).tolist() == [3, 6, 8]


def test_prominence_and_width():
    y = np.array([0, 1, 3, 1, 2, 1, 0], float)
    prom, left, right = k.prominences(y, np.array([2, 4]))
    assert prom.tolist() == [3, 1]
    w, lo, hi = k.widths(y, np.array([2]), 0.5)
    assert lo[0] == 1.25 and hi[0] == pytest.approx(2.75) and w[0] == pytest.approx(1.5)


def test_simpson():
    x = np.arange(7.0)
    assert k.simpson(x**2) == pytest.approx(72)
    assert k.simpson(np.arange(6.0) ** 2) == pytest.approx(125 / 3)
    assert k.simpson(np.array([3.0])) == 0 and k.simpson(np.array([1.0, 3.0])) == 2


@given(st.lists(st.integers(0, 60), min_size=1, max_size=25), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_suppression_keeps_peaks_apart(heights, reach):
    at = np.arange(len(heights)) * 2
    kept = k.suppress(at, np.array(heights), reach)
    assert (np.diff(at[kept]) > reach).all() and int(np.argmax(heights)) in kept


def test_run_decoding_may_enter_a_run_again():
    cls = np.array([4, 0, 0, 0, 0, 0, 0, 1, 1])
    conf = np.array([1, 0.9, 0.95, 0.9, 0.9, 0.9, 0.92, 0.5, 0.9])
    assert k.decode_runs(cls, conf, 0.8).tolist() == [2, 6]


def _brute(q, r):
    n, m = len(q), len(r)
    s, t = np.zeros((n + 1, m + 1), int), np.zeros((n + 1, m + 1), int)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            opts = [0, s[i - 1, j - 1] + (2 if q[i - 1] == r[j - 1] else -3), s[i - 1, j] + (-1 if t[i - 1, j] == 2 else -10), s[i, j - 1] + (-1 if t[i, j - 1] == 3 else -10)]
            t[i, j] = int(np.argmax(opts))
            s[i, j] = max(opts)
    return s.max()


@given(st.text("ACGT", max_size=18), st.text("ACGT", max_size=18))
@settings(max_examples=80, deadline=None)
def test_alignment_score_matches_cell_by_cell(q, r):
    assert k.align_local(q, r)["score"] == _brute(q, r)


def test_alignment_of_a_prefix():
    ref = "GAATTCGAGCTCGGTACCCGGGGATCCTCTAGAGTCGACCTGCAGGCATGCAAGCTTGGCACTGGCCGTCGTTTTACAACG"
    got = k.align_local(ref[:75], ref)
    assert (got["score"], got["matches"], got["aligned"], got["identity"]) == (150, 75, 75, 1.0)
    assert k.align_local("", ref)["aligned"] == 0


def test_smoothing_rows_reproduce_quadratics_and_known_taps():
    x = np.arange(7.0)
    assert np.allclose(fit_rows(7) @ (3 * x**2 - x + 2), 3 * x**2 - x + 2)
    assert np.allclose(fit_rows(7)[3] * 21, [-2, 3, 6, 7, 6, 3, -2])
    assert np.allclose(fit_rows(11)[5] * 429, [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36])


def test_als_matches_a_dense_solver():
    r = np.random.default_rng(1)
    y = r.normal(0, 1, 80).cumsum() + 10
    d = np.diff(np.eye(80), 2, axis=0)
    w = np.ones(80)
    for _ in range(10):
        z = np.linalg.solve(np.diag(w) + 100.0 * d.T @ d, w * y)
        w = 0.01 * (y > z) + 0.99 * (y < z)
    assert np.allclose(als_curve(y, 100.0), z)
    assert als_curve(np.array([1.0, 2.0]), 10.0).tolist() == [1.0, 2.0]


def test_gaussian_fit_finds_its_own_peaks():
    x = np.arange(60.0)
    true = np.array([[100, 20, 3], [60, 30, 4]])
    y = sum(a * np.exp(-0.5 * ((x - m) / s) ** 2) for a, m, s in true)
    fit = k.fit_gaussians(x, y, np.array([[90, 21, 3.0], [50, 29, 3.0]]))
    assert np.allclose(fit, true, rtol=1e-3)
    assert k.fit_gaussians(x[:2], y[:2], true) is None
