"""Sequential steps on one trace's samples, as small functions on arrays.

They run inside grouped Spark functions, one trace at a time, and are documented with their tie rules.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


def local_maxima(y: np.ndarray) -> np.ndarray:
    """Places that rise strictly before and fall strictly after; a plateau counts at its middle, ends never do."""
    if len(y) < 3:
        return np.zeros(0, int)
    begin = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1])))
    end = np.append(begin[1:], len(y)) - 1
    v = y[begin]
    top = np.zeros(len(v), bool)
    top[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    return (begin[top] + end[top]) // 2


def apart(places: np.ndarray, priority: np.ndarray, distance: float | np.ndarray) -> np.ndarray:
    """Which places stay if each, from the highest priority down, removes those nearer than ``distance`` (one for all, or each its own); of equals the later goes first."""
    keep, need = np.ones(len(places), bool), np.ceil(distance).astype(int)
    lo, hi = np.searchsorted(places, places - need + 1).tolist(), np.searchsorted(places, places + need).tolist()
    for i in np.lexsort((np.arange(len(places)), priority))[::-1].tolist():
        if keep[i]:
            keep[lo[i] : hi[i]] = False
            keep[i] = True
    return keep


def _levels(y: np.ndarray, pick: np.ufunc) -> list[np.ndarray]:
    """The greatest (or least) of the 1, 2, 4, ... samples from each place on."""
    out, w = [y], 1
    while 2 * w <= len(y):
        out.append(pick(out[-1][:-w], out[-1][w:]))
        w *= 2
    return out


def _leftward(levels: list[np.ndarray], end: np.ndarray, passes: Callable[[np.ndarray], np.ndarray], floor: np.ndarray | int = 0) -> np.ndarray:
    """Where the run of samples that ``passes`` and ends before ``end`` begins, not below ``floor``; all places at once, by halving blocks."""
    for i in range(len(levels) - 1, -1, -1):
        at = end - (1 << i)
        end = np.where((at >= floor) & passes(levels[i][np.maximum(at, 0)]), at, end)
    return end


def _rightward(levels: list[np.ndarray], begin: np.ndarray, passes: Callable[[np.ndarray], np.ndarray], ceiling: np.ndarray | int) -> np.ndarray:
    """Where the run of samples that ``passes`` from ``begin`` on ends, not beyond ``ceiling``; both ends half open."""
    for i in range(len(levels) - 1, -1, -1):
        to = begin + (1 << i)
        begin = np.where((to <= ceiling) & passes(levels[i][np.minimum(begin, len(levels[i]) - 1)]), to, begin)
    return begin


def prominences(y: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Height above the higher of the two valleys that part a peak from greater samples, and the valleys' places."""
    if not len(peaks):
        return np.zeros(0), np.zeros(0, int), np.zeros(0, int)
    if np.isnan(y).any():
        return _prominences_by_scan(y, peaks)
    high, low, top = _levels(y, np.maximum), _levels(y, np.minimum), y[peaks]
    lo = _leftward(high, peaks, lambda v: v <= top)
    hi = _rightward(high, peaks + 1, lambda v: v <= top, len(y))

    def least(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        level, out = np.log2(end - begin + 0.5).astype(int), np.zeros(len(begin))
        for i in np.unique(level):
            at = level == i
            out[at] = np.minimum(low[i][begin[at]], low[i][end[at] - (1 << i)])
        return out

    before, after = least(lo, peaks + 1), least(peaks, hi)
    left = _leftward(low, peaks + 1, lambda v: v > before) - 1
    right = _rightward(low, peaks, lambda v: v > after, len(y))
    return top - np.maximum(before, after), left, right


def _prominences_by_scan(y: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, peak by peak, for traces with missing samples."""
    prom, left, right = np.zeros(len(peaks)), np.zeros(len(peaks), int), np.zeros(len(peaks), int)
    for k, p in enumerate(peaks):
        higher = np.flatnonzero(y[:p] > y[p])
        lo = higher[-1] + 1 if len(higher) else 0
        higher = np.flatnonzero(y[p + 1 :] > y[p])
        hi = p + higher[0] if len(higher) else len(y) - 1
        before, after = y[lo : p + 1], y[p : hi + 1]
        left[k] = lo + len(before) - 1 - np.argmin(before[::-1])
        right[k] = p + np.argmin(after)
        prom[k] = y[p] - max(y[left[k]], y[right[k]])
    return prom, left, right


def widths(y: np.ndarray, peaks: np.ndarray, rel: float, valleys: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, origin: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Width at ``rel`` of the prominence below the top, with its interpolated ends, counted from ``origin``; ``valleys`` are the peaks' ``prominences``, if known."""
    prom, left, right = valleys or prominences(y, peaks)
    if not len(peaks):
        return np.zeros(0), np.zeros(0), np.zeros(0)
    level = y[peaks] - rel * prom
    low, over = _levels(y, np.fmin), lambda v: ~(v <= level)
    i = np.maximum(_leftward(low, peaks + 1, over, left) - 1, left)
    k = np.minimum(_rightward(low, peaks, over, right + 1), right)
    with np.errstate(divide="ignore", invalid="ignore"):
        lo = np.where(y[i] < level, i - origin + (level - y[i]) / (y[np.minimum(i + 1, len(y) - 1)] - y[i]), i - origin)
        hi = np.where(y[k] < level, k - origin - (level - y[k]) / (y[k - 1] - y[k]), k - origin)
    return hi - lo, lo, hi


def find_peaks(y: np.ndarray, height: float | None = None, distance: float | None = None, prominence: float | None = None, width: float | None = None) -> np.ndarray:
    """Local maxima that pass, in this order: height, distance, prominence, half-prominence width."""
    return find_many([y], height, distance, prominence, width).place


@dataclass
class Peaks:
    """Peaks of many traces: each one's trace, place in it and prominence; ``y`` has the traces one behind the other, from ``first`` on, ``at`` the places there, ``valleys`` their ``prominences``."""

    y: np.ndarray
    first: np.ndarray
    trace: np.ndarray
    at: np.ndarray
    valleys: tuple[np.ndarray, np.ndarray, np.ndarray] | None

    @property
    def place(self) -> np.ndarray:
        return self.at - self.first[self.trace]

    def where(self, keep: np.ndarray) -> Peaks:
        return Peaks(self.y, self.first, self.trace[keep], self.at[keep], self.valleys and tuple(v[keep] for v in self.valleys))

    def widths(self, rel: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``widths`` of the peaks, their ends as places in the trace."""
        return widths(self.y, self.at, rel, self.valleys, self.first[self.trace])

    def with_valleys(self) -> Peaks:
        return self if self.valleys else Peaks(self.y, self.first, self.trace, self.at, prominences(self.y, self.at))


def find_many(traces: list[np.ndarray], height=None, distance=None, prominence=None, width=None) -> Peaks:
    """``find_peaks`` of many traces at once; each bound is one number, or one for each trace. An infinite sample parts neighbours, so that no search crosses it."""
    size = np.array([len(t) for t in traces], int)
    first = np.cumsum(size + 1) - size - 1
    wall = np.array([np.inf])
    y = np.concatenate([x for t in traces for x in (t, wall)] or [wall]).astype(float)
    at = local_maxima(y)
    at = at[~np.isin(at, first + size)]
    p = Peaks(y, first, np.searchsorted(first, at, side="right") - 1, at, None)
    of = lambda bound: np.asarray(bound)[p.trace] if np.ndim(bound) else bound
    if height is not None:
        p = p.where(y[p.at] >= of(height))
    if distance is not None:
        p = p.where(apart(p.at + p.trace * int(np.ceil(np.max(distance, initial=1))), y[p.at], of(distance)))
    if prominence is not None:
        p = p.with_valleys()
        p = p.where(p.valleys[0] >= of(prominence))
    if width is not None:
        p = p.with_valleys()
        p = p.where(p.widths(0.5)[0] >= of(width))
    return p


def smoothed(y: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """``y`` by rows of weights (``stencils.fit_rows``): the middle row inside, the outer ones at the ends; raw if there are fewer samples."""
    width, half = len(taps), len(taps) // 2
    if len(y) < width:
        return y
    out = np.convolve(y, taps[half][::-1], "same")
    out[:half], out[-half:] = taps[:half] @ y[:width], taps[half + 1 :] @ y[-width:]
    return out


def groups_over(scan: np.ndarray, y: np.ndarray, begin: np.ndarray, ratio: float, gap: int, head: int, least_range: float) -> tuple[np.ndarray, ...]:
    """Runs of two or more samples above ``ratio`` of the way from the median of a trace's scans before ``head`` to its top, parted at gaps over ``gap``.

    ``begin``: where each trace begins, and the end. Each run's trace, the rows of its top (first of equals) and of its first and last sample, how many samples it has and their sum.
    """
    n, of = len(begin) - 1, np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    base, top = np.full(n, np.nan), np.full(n, np.nan)
    for t, (i, j) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
        first = np.sort(y[i:j][(scan[i:j] < head) & ~np.isnan(y[i:j])])
        if len(first):
            base[t], top[t] = 0.5 * first[(len(first) - 1) // 2] + 0.5 * first[len(first) // 2], np.nanmax(y[i:j])
    over = np.flatnonzero((top - base >= least_range)[of] & (y > (base + (top - base) * ratio)[of]))
    new = np.append(True, (np.diff(of[over]) > 0) | (np.diff(scan[over]) > gap))[: len(over)]
    start, run = np.flatnonzero(new), np.cumsum(new) - 1
    last = np.append(start[1:], len(over)) - 1
    tops = over[np.lexsort((over, -y[over], run))[start]]
    many = last > start
    area = np.add.reduceat(y[over], start) if len(start) else np.zeros(0)
    return of[tops][many], tops[many], over[start][many], over[last][many], (last - start + 1)[many], area[many]


def half_widths(y: np.ndarray, at: np.ndarray, height: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest places on both sides of each peak, within its [begin, end), that are not above half its height, or the ends."""
    low, over = _levels(y, np.minimum), lambda v: v > height / 2
    return np.maximum(_leftward(low, at, over, begin) - 1, begin), np.minimum(_rightward(low, at + 1, over, end), end - 1)


def top_widths(y: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The width at half prominence of the greatest sample (the first of equals) of each stretch [begin, end), seen within it alone."""
    size = end - begin
    first, wall = np.cumsum(size + 1) - size - 1, np.array([np.inf])
    walled = np.concatenate([x for i, j in zip(begin.tolist(), end.tolist()) for x in (y[i:j], wall)] or [wall])
    top = np.array([int(np.argmax(y[i:j])) for i, j in zip(begin.tolist(), end.tolist())], int)
    return widths(walled, first + top, 0.5, origin=first)[0]


def matched_before(standards: list[int], samples: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Each standard place, in order, with the nearest sample place not yet used that stands ``low`` to ``high`` before it."""
    used, out, places = set(), [], sorted(samples)
    for at in sorted(standards):
        free = [x for x in places[bisect_left(places, at - high) : bisect_right(places, at - low)] if x not in used]
        if free:
            used.add(free[-1])
            out.append((at, free[-1]))
    return out


def simpson(y: np.ndarray, h: float = 1.0) -> float:
    """Composite Simpson; an even number of samples ends with the three-point correction of the last interval."""
    n = len(y)
    if n < 2:
        return 0.0
    if n == 2:
        return float(h * (y[0] + y[1]) / 2)
    m = n if n % 2 else n - 1
    total = h / 3 * (y[0] + y[m - 1] + 4 * y[1 : m - 1 : 2].sum() + 2 * y[2 : m - 2 : 2].sum())
    if m < n:
        total += h * (5 / 12 * y[-1] + 2 / 3 * y[-2] - 1 / 12 * y[-3])
    return float(total)


def simpsons(y: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``simpson`` of the samples from each ``left`` to its ``right``, both included; stretches of one length at a time."""
    size, out = right - left + 1, np.zeros(len(left))
    for n in np.unique(size[size > 1]).tolist():
        at = np.flatnonzero(size == n)
        part = y[left[at, None] + np.arange(n)]
        if n == 2:
            out[at] = (part[:, 0] + part[:, 1]) / 2
            continue
        m = n if n % 2 else n - 1
        total = (part[:, 0] + part[:, m - 1] + 4 * part[:, 1 : m - 1 : 2].sum(axis=1) + 2 * part[:, 2 : m - 2 : 2].sum(axis=1)) / 3
        out[at] = total + (5 / 12 * part[:, -1] + 2 / 3 * part[:, -2] - 1 / 12 * part[:, -3] if m < n else 0.0)
    return out


def suppress(positions: np.ndarray, heights: np.ndarray, reach: float) -> np.ndarray:
    """Indices kept when, by falling height (first of equals first), each keeps only if farther than ``reach`` from all kept; in place order."""
    order = np.argsort(positions, kind="stable")
    ranked = np.asarray(positions)[order]
    lo, hi = np.searchsorted(ranked, ranked - reach, "left"), np.searchsorted(ranked, ranked + reach, "right")
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order))
    near, free, kept = np.stack([lo, hi], axis=1).tolist(), np.ones(len(order), bool), []
    for i in rank[np.lexsort((np.arange(len(heights)), -np.asarray(heights)))].tolist():
        if free[i]:
            kept.append(i)
            free[near[i][0] : near[i][1]] = False
    return order[np.sort(np.array(kept, int))]


def decode_runs(classes: np.ndarray, confidence: np.ndarray, least: float, background: int = 4, skip: int = 3) -> np.ndarray:
    """One call per run of a class: its most confident place; the search goes on ``skip`` places later, perhaps in the same run."""
    out, i = [], 0
    while i < len(classes):
        if classes[i] >= background or confidence[i] < least:
            i += 1
            continue
        j = i
        while j < len(classes) and classes[j] == classes[i] and confidence[j] >= least:
            j += 1
        best = i + int(np.argmax(confidence[i:j]))
        out.append(best)
        i = best + skip
    return np.array(out, int)


#: Widths from a Gaussian's centre at which it is below the rounding of its top.
REACH = 8.6

#: The share of the sum of squares that a round gains once a fit is near its end.
NEAR = 1e-3


def _coupled_blocks(q: np.ndarray) -> list[tuple[int, int]]:
    """Runs of the Gaussians (in order of their centres) such that only those of one run, or of neighbouring runs, overlap."""
    c, w, n = q[:, 1], q[:, 2], len(q)
    near = c - c[:, None] <= REACH * np.hypot(w, w[:, None])
    last, edges = np.maximum.accumulate(n - np.argmax(near[:, ::-1], axis=1)).tolist(), [0]
    while edges[-1] < n:
        at = edges[-1]
        edges.append(min(n, max(last[at - 1] if at else last[0], at + 32)))
    return list(zip(edges, edges[1:]))


def _bells(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each Gaussian a row: the places of the samples where it is above rounding (rows of one length), their distances from its centre in widths, and its shape of height 1 there."""
    first = np.searchsorted(x, q[:, 1] - REACH * q[:, 2])
    size = int((np.searchsorted(x, q[:, 1] + REACH * q[:, 2]) - first).max())
    at = np.minimum(first, len(x) - size)[:, None] + np.arange(size)
    u = (x[at] - q[:, 1, None]) / q[:, 2, None]
    return at, u, np.exp(-0.5 * u * u)


def _normal_blocks(rest: np.ndarray, q: np.ndarray, bells: tuple, blocks: list[tuple[int, int]], second: bool, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Which numbers are free to move, and of these the blocks of a step's matrix on its diagonal and beside it, the right side, and what is damped; ``rest`` is what the model leaves of the samples.

    Numbers at a bound that the sum of squares pushes beyond it are not free. The matrix is the normal one, or with ``second`` that of Newton's step: second derivatives couple one Gaussian's own numbers alone.
    """
    at, u, e = bells
    a, w, size = q[:, 0, None], q[:, 2, None], at.shape[1]
    slope = a / w * e * u
    jac, r, first = np.stack([e, slope, slope * u], axis=1), rest[at], at[:, 0]
    right = (jac @ r[:, :, None])[:, :, 0]
    free = ~((q <= low) & (right <= 0) | (q >= high) & (right >= 0))
    own, beside, before = [], [], None
    for i, j in blocks:
        lo, hi = int(first[i:j].min()), int(first[i:j].max()) + size
        m = np.zeros((j - i, 3, hi - lo))
        for g, to in enumerate((first[i:j] - lo).tolist()):
            m[g, :, to : to + size] = jac[i + g]
        m = m[free[i:j]]
        own.append(m @ m.T)
        if before:
            begin, end = max(lo, before[0]), min(hi, before[1])
            shared = lambda start, b: b[:, begin - start : max(begin, end) - start]  # noqa: B023, E731
            beside.append(shared(before[0], before[2]) @ shared(lo, m).T)
        before = lo, hi, m
    damped = [np.diagonal(b).copy() for b in own]
    if second:
        moments, v = [], r * e
        for _ in range(5):
            moments.append(v.sum(axis=1))
            v = v * u
        m0, m1, m2, m3, m4 = moments
        a, w = q[:, 0], q[:, 2]
        bend = np.zeros((len(q), 3, 3))
        for (s, t), value in {(0, 1): m1 / w, (0, 2): m2 / w, (1, 1): a * (m2 - m0) / w**2, (1, 2): a * (m3 - 2 * m1) / w**2, (2, 2): a * (m4 - 3 * m2) / w**2}.items():
            bend[:, s, t] = bend[:, t, s] = value
        for b, (i, j) in zip(own, blocks):
            whole, of, g = np.zeros((j - i, 3, j - i, 3)), np.flatnonzero(free[i:j]), np.arange(j - i)
            whole[g, :, g, :] = bend[i:j]
            b -= whole.reshape(3 * (j - i), -1)[of[:, None], of]
    return free, own, beside, [right[i:j][free[i:j]] for i, j in blocks], damped


def _solved(own: list[np.ndarray], beside: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Solution of a system whose matrix is symmetric and block tridiagonal, by elimination from block to block."""
    uppers, sides = [], []
    for i, a in enumerate(own):
        r = right[i]
        if i:
            a = a - beside[i - 1].T @ uppers[-1]
            r = r - beside[i - 1].T @ sides[-1]
        m = np.linalg.solve(a, np.column_stack([beside[i], r]) if i < len(beside) else r[:, None])
        uppers.append(m[:, :-1])
        sides.append(m[:, -1])
    for i in range(len(own) - 2, -1, -1):
        sides[i] = sides[i] - uppers[i] @ sides[i + 1]
    return np.concatenate(sides)


def _damped_step(normal: tuple, damp: float) -> np.ndarray:
    """The step of the free numbers; the others stay."""
    free, own, beside, right, damped = normal
    a = [m.copy() for m in own]
    for m, d in zip(a, damped):
        m.flat[:: len(d) + 1] += damp * (d + 1e-12)
    step = np.zeros(free.shape)
    step[free] = _solved(a, beside, right)
    return step


def fit_gaussians(x: np.ndarray, y: np.ndarray, start: np.ndarray, rounds: int = 200) -> np.ndarray | None:
    """Amplitude, centre and width of some Gaussians by damped least squares with bounds; null if a step can't be worked out.

    ``start`` has a row (amplitude, centre, width) per peak; ``x`` ascends. Amplitudes stay in [0, 2 max], widths in [0.5, 10].
    Numbers at a bound that the sum of squares pushes beyond it are left out of a step, without which fits never settle; once a round gains
    less than ``NEAR``, steps use second derivatives too. A Gaussian is worked out where it is above rounding only, so the matrix is block
    tridiagonal; a rejected step keeps it.
    """
    if not len(start) or len(x) < 3 * len(start):
        return None
    top = max(float(y.max()), 1e-9)
    low, high = np.array([0.0, x[0], 0.5]), np.array([2 * top, x[-1], 10.0])
    model = lambda q, bells: np.bincount(bells[0].ravel(), (q[:, 0, None] * bells[2]).ravel(), len(x))
    q, order, normal, damp, grow, gain = np.clip(start.astype(float), low, high), np.arange(len(start)), None, 1e-3, 4, 1.0
    by = np.argsort(q[:, 1], kind="stable")
    q, order = q[by], order[by]
    bells = _bells(x, q)
    rest = y - model(q, bells)
    cost = float(rest @ rest)
    for _ in range(rounds):
        if normal is None:
            if (np.diff(q[:, 1]) < 0).any():
                by = np.argsort(q[:, 1], kind="stable")
                q, order, bells = q[by], order[by], tuple(b[by] for b in bells)
            blocks = _coupled_blocks(q)
            normal = _normal_blocks(rest, q, bells, blocks, gain < NEAR, low, high)
            if not normal[0].any():
                break
        try:
            step = _damped_step(normal, damp)
        except np.linalg.LinAlgError:
            return None
        r = np.clip(q + step, low, high)
        tried = _bells(x, r)
        left = y - model(r, tried)
        new = float(left @ left)
        if new < cost:
            gain = (cost - new) / max(cost, 1e-12)
            q, bells, rest, normal, cost, damp, grow = r, tried, left, None, new, max(damp / 5, 1e-12), 4
            if gain < 1e-10:
                break
        else:
            damp, grow = damp * grow, grow * 4
            if damp > 1e12:
                break
    return q[np.argsort(order)]


def align_local(query: str, ref: str, match: int = 2, mismatch: int = -3, gap_open: int = -10, gap_extend: int = -1) -> dict:
    """Best local alignment: a gap extends if the cell it comes from was itself reached by that gap. Ties: stop, diagonal, up, left; the first best cell by rows.

    Cells of one anti-diagonal do not depend on each other, so each is one step on arrays, indexed by the place in ``ref``. Only the last two
    are held, and every so many are kept as a restart; the way back works out again the stretches that it crosses. Memory is
    about 20 * len(ref) * sqrt(len(query) + len(ref)) bytes, not the product of the lengths.
    """
    n, m = len(query), len(ref)
    a, b = np.frombuffer(query.encode("latin-1", "replace"), np.uint8), np.frombuffer(ref.encode("latin-1", "replace"), np.uint8)
    stretch = max(64, int((n + m) ** 0.5))
    blank = lambda: (np.zeros(m + 1, np.int32), np.zeros(m + 1, np.int32), np.zeros(m + 1, np.int8))

    def forward(state: tuple, s: int) -> tuple[tuple, int, int]:
        """The state one diagonal on, and the columns it has cells in."""
        before, last, came = state
        lo, hi = max(1, s - n), min(m, s - 1)
        diagonal = before[lo - 1 : hi] + np.where(a[s - hi - 1 : s - lo][::-1] == b[lo - 1 : hi], match, mismatch)
        up = last[lo : hi + 1] + np.where(came[lo : hi + 1] == 2, gap_extend, gap_open)
        left = last[lo - 1 : hi] + np.where(came[lo - 1 : hi] == 3, gap_extend, gap_open)
        options = np.stack([np.zeros_like(diagonal), diagonal, up, left])
        score, trace = np.zeros(m + 1, np.int32), np.zeros(m + 1, np.int8)
        trace[lo : hi + 1], score[lo : hi + 1] = options.argmax(axis=0), options.max(axis=0)
        return (last, score, trace), lo, hi

    state, restarts, best, i, j = blank(), [], 0, 0, 0
    for s in range(2, n + m + 1):
        if (s - 2) % stretch == 0:
            restarts.append(state)
        state, lo, hi = forward(state, s)
        top = int(state[1][lo : hi + 1].max(initial=0)) if hi >= lo else 0
        if top >= best and top > 0:
            at = hi - int(np.argmax(state[1][lo : hi + 1][::-1] == top))  # the last column is the first row
            if top > best or (s - at, at) < (i, j):
                best, i, j = top, s - at, at
    qe, re_, q, r = i, j, [], []
    block, traces = -1, []
    while i > 0 and j > 0:
        if block != (i + j - 2) // stretch:
            block = (i + j - 2) // stretch
            state, traces = restarts[block], []
            for s in range(2 + block * stretch, min(2 + (block + 1) * stretch, n + m + 1)):
                state, _, _ = forward(state, s)
                traces.append(state[2])
        t = traces[i + j - 2 - block * stretch][j]
        if not t:
            break
        q.append(query[i - 1] if t != 3 else "-")
        r.append(ref[j - 1] if t != 2 else "-")
        i, j = i - (t != 3), j - (t != 2)
    q, r = "".join(reversed(q)), "".join(reversed(r))
    same = sum(x == y and x != "-" for x, y in zip(q, r))
    return {"score": best, "query_start": i, "query_end": qe, "ref_start": j, "ref_end": re_, "aligned": len(q), "matches": same, "identity": same / len(q) if q else 0.0, "query_line": q, "ref_line": r}
