"""The numerical kernel: trigonometric sums and the best phase at many frequencies at once, in numpy."""

from __future__ import annotations

import numpy as np

LEAST = 1e-12


def trig_sums(t: np.ndarray, w: np.ndarray, yc: np.ndarray, freqs: np.ndarray, harmonics: int) -> np.ndarray:
    """(freq, 6H): c1..c2H, s1..s2H, yc1..ycH, ys1..ysH."""
    out = np.empty((len(freqs), 6 * harmonics))
    both = np.stack([w, w * yc], axis=1)
    step = max(1, 200_000 // max(len(t), 1))
    for a in range(0, len(freqs), step):
        base = np.exp(2j * np.pi * np.outer(freqs[a : a + step], t))
        turn = base.copy()
        for h in range(1, 2 * harmonics + 1):
            got = turn @ both
            out[a : a + step, h - 1], out[a : a + step, 2 * harmonics + h - 1] = got[:, 0].real, got[:, 0].imag
            if h <= harmonics:
                out[a : a + step, 4 * harmonics + h - 1], out[a : a + step, 5 * harmonics + h - 1] = got[:, 1].real, got[:, 1].imag
            turn = turn * base
    return out


#: Grid points that an observation is spread over to each side; with twice as many grid points as frequencies the error is about 1e-10.
SPREAD = 12
#: Observations times frequencies from which the fast sums take less time.
FAST_FROM = 20_000


def grid_sums(t: np.ndarray, w: np.ndarray, yc: np.ndarray, step: float, first: int, count: int, harmonics: int) -> np.ndarray:
    """``trig_sums`` at the even grid step * (first + k), k < count, by non-equispaced fast Fourier transforms.

    For each harmonic the observations are spread by a Gaussian over a grid of phases, which one transform takes to all
    frequencies; dividing by the Gaussian's own transform undoes the spreading. That takes about
    harmonics * (observations + count log count) steps instead of harmonics * observations * count.
    """
    out = np.empty((count, 6 * harmonics))
    size = 2 << max(count - 1, 16).bit_length()
    middle = count // 2
    k = np.arange(count) - middle
    wide = SPREAD * size / count / (2 * size / count - 1) * 2 / np.pi  # width of the Gaussian in grid points, squared
    undo = np.exp(wide * (np.pi * k / size) ** 2)
    near = np.arange(-SPREAD + 1, SPREAD + 1)
    for h in range(1, 2 * harmonics + 1):
        turns = t * (step * h)
        x = (turns - np.floor(turns)) * size
        low = np.floor(x).astype(np.int64)
        spread = np.exp(-((x - low)[:, None] - near) ** 2 / wide) / np.sqrt(np.pi * wide)
        place = ((low[:, None] + near) % size).ravel()
        start = turns * (first + middle)
        phase = np.exp(2j * np.pi * (start - np.floor(start)))
        for weights, cosines, use in ((w, h - 1, True), (w * yc, 4 * harmonics + h - 1, h <= harmonics)):
            if use:
                own = spread * (weights * phase)[:, None]
                held = np.bincount(place, own.real.ravel(), size) + 1j * np.bincount(place, own.imag.ravel(), size)
                found = np.fft.ifft(held)[k % size] * size * undo
                out[:, cosines], out[:, cosines + (2 * harmonics if cosines < 2 * harmonics else harmonics)] = found.real, found.imag
    return out


def matrices(sums: np.ndarray, harmonics: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(covariance of (cos, sin) (freq, 2H, 2H), their covariance with y (freq, 2H), their means (freq, 2H))."""
    h, n = harmonics, len(sums)
    c = np.concatenate([np.ones((n, 1)), sums[:, : 2 * h]], axis=1)
    s = np.concatenate([np.zeros((n, 1)), sums[:, 2 * h : 4 * h]], axis=1)
    j, k = np.meshgrid(np.arange(1, h + 1), np.arange(1, h + 1), indexing="ij")
    d, plus, sign = np.abs(k - j), j + k, np.sign(k - j)
    mean = np.concatenate([c[:, 1 : h + 1], s[:, 1 : h + 1]], axis=1)
    cross = (s[:, plus] + sign * s[:, d]) / 2
    second = np.concatenate([np.concatenate([(c[:, d] + c[:, plus]) / 2, cross], axis=2), np.concatenate([cross.transpose(0, 2, 1), (c[:, d] - c[:, plus]) / 2], axis=2)], axis=1)
    return second - mean[:, :, None] * mean[:, None, :], sums[:, 4 * h :], mean


def shifted(c: np.ndarray, s: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Coefficients (..., 2H) of the template delayed by theta."""
    x = theta[..., None] * np.arange(1, len(c) + 1)
    return np.concatenate([c * np.cos(x) - s * np.sin(x), c * np.sin(x) + s * np.cos(x)], axis=-1)


def waves(theta: np.ndarray, degree: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cosine and sine of 1, 2, ... degree times theta, by turning on."""
    turn = np.exp(1j * theta)
    out, now = [], turn
    for _ in range(degree):
        out.append((now.real.copy(), now.imag.copy()))
        now = now * turn
    return out


class Harmonics:
    """Real trigonometric polynomials, one a row, by their values on an even grid; exact if the grid has more points than twice their degree."""

    def __init__(self, values: np.ndarray, degree: int):
        c = np.fft.rfft(values, axis=1)[:, : degree + 1] / values.shape[1]
        self.first = c[:, :1].real.copy()
        self.parts = [(2 * c[:, k : k + 1].real, 2 * c[:, k : k + 1].imag) for k in range(1, degree + 1)]

    def value(self, turns: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The value; turns: ``waves`` of the phases."""
        out = np.broadcast_to(self.first, turns[0][0].shape).copy()
        for (a, b), (cos, sin) in zip(self.parts, turns):
            out += a * cos - b * sin
        return out

    def at(self, turns: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value and first two derivatives."""
        out, one, two = np.broadcast_to(self.first, turns[0][0].shape).copy(), np.zeros(turns[0][0].shape), np.zeros(turns[0][0].shape)
        for k, ((a, b), (cos, sin)) in enumerate(zip(self.parts, turns), 1):
            even = a * cos - b * sin
            out += even
            one -= k * (a * sin + b * cos)
            two -= k * k * even
        return out, one, two


#: Phases that are refined for each frequency, and steps of refinement, which halve a bracket at least.
PEAKS, STEPS = 3, 7


def best_phase(sums: np.ndarray, c, s, ybar, yy, allow_negative: bool = True) -> np.ndarray:
    """(freq, 6): power, a, b, c, sgn, theta of the best fit; NaN where no fit is defined. ybar and yy are numbers or one a row.

    The explained share is the square of one trigonometric polynomial in the phase over another. It is scanned on a grid
    that grows with the harmonics, and its highest local maxima are refined by bracketed Newton steps on the derivative:
    the highest grid point alone isn't always in the highest peak.
    """
    c, s = np.asarray(c, float), np.asarray(s, float)
    h = len(c)
    ybar, yy = np.broadcast_to(np.asarray(ybar, float), len(sums)), np.broadcast_to(np.asarray(yy, float), len(sums))
    out = np.full((len(sums), 6), np.nan)
    some = np.flatnonzero(yy > 0)
    if not len(some):
        return out
    cov, with_y, mean = matrices(sums[some], h)
    ybar, yy = ybar[some], yy[some, None]
    size = max(64, 12 * h)
    grid = 2 * np.pi * np.arange(size) / size
    v = shifted(c, s, grid)
    ym = with_y @ v.T
    mm = cov.reshape(len(some), -1) @ (v[:, :, None] * v[:, None, :]).reshape(size, -1).T
    share = lambda ym, mm: np.where(mm > LEAST, ym**2 / np.where(mm > LEAST, mm, 1) / yy, -1.0)
    p = share(ym, mm)
    peak = np.where((p >= np.roll(p, 1, axis=1)) & (p >= np.roll(p, -1, axis=1)), p, -2.0)
    best = np.argpartition(-peak, PEAKS - 1, axis=1)[:, :PEAKS]
    at = grid[np.take_along_axis(best, np.argsort(-np.take_along_axis(peak, best, axis=1), axis=1, kind="stable"), axis=1)]
    top, below = Harmonics(ym, h), Harmonics(mm, 2 * h)
    lo, hi, theta = at - 2 * np.pi / size, at + 2 * np.pi / size, at
    moved = hi - lo
    for _ in range(STEPS):
        turns = waves(theta, 2 * h)
        (y, y1, y2), (m, m1, m2) = top.at(turns), below.at(turns)
        slope, bend = 2 * y1 * m - y * m1, 2 * y2 * m + y1 * m1 - y * m2
        rising = slope * y > 0
        lo, hi = np.where(rising, theta, lo), np.where(rising, hi, theta)
        new = theta - slope / np.where(bend != 0, bend, np.inf)
        new = np.where((new >= lo) & (new <= hi) & (np.abs(new - theta) < np.maximum(moved, 1e-6)), new, (lo + hi) / 2)
        moved, theta = np.abs(new - theta), new
    theta = np.concatenate([theta, at], axis=1)
    turns = waves(theta, 2 * h)
    p = share(top.value(turns), below.value(turns))
    row, best = np.arange(len(p)), p.argmax(axis=1)
    theta = theta[row, best] % (2 * np.pi)
    v = shifted(c, s, theta)
    mm = np.einsum("fi,fij,fj->f", v, cov, v)
    ok = mm > LEAST
    a = (v * with_y).sum(axis=1) / np.where(ok, mm, 1)
    p = a * (v * with_y).sum(axis=1) / yy[:, 0]
    if not c[1::2].any() and not s[1::2].any():  # (a, theta) and (-a, theta + pi) are the same fit
        turn = a < 0
        theta, a, v = np.where(turn, (theta + np.pi) % (2 * np.pi), theta), np.abs(a), np.where(turn[:, None], -v, v)
    elif not allow_negative:
        p, a = np.where(a < 0, 0.0, p), np.where(a < 0, 0.0, a)
    offset = ybar - a * (v * mean).sum(axis=1)
    out[some[ok]] = np.stack([p, a, np.cos(theta), offset, np.sign(np.sin(theta)), theta], axis=1)[ok]
    return out


def slow_chi2_polynomials(sums: np.ndarray, plain: np.ndarray, c, s, size: int) -> list[np.ndarray]:
    """At size even phases, what ``slow_chi2`` takes: (freq, size) each of cov(m, y), var(m), mean(m) less its plain one, and plain cov(m, y) and var(m)."""
    h = len(c)
    (cov, with_y, mean), (own, own_y, own_mean) = matrices(sums, h), matrices(plain, h)
    v = shifted(np.asarray(c, float), np.asarray(s, float), 2 * np.pi * np.arange(size) / size)
    both = (v[:, :, None] * v[:, None, :]).reshape(size, -1).T
    return [with_y @ v.T, cov.reshape(len(cov), -1) @ both, (mean - own_mean) @ v.T, own_y @ v.T, own.reshape(len(own), -1) @ both]


def slow_chi2(parts: list[np.ndarray], shift: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Weighted residuals, over the sum of the weights, of unweighted linear fits; NaN where no fit is defined."""
    with_y, var, mean, own_y, own = parts
    a = own_y / np.where(own > LEAST, own, np.nan)
    # y - a m - b, about the weighted means of y and m: b is chosen for the plain means.
    return yy - 2 * a * with_y + a**2 * var + (shift - a * mean) ** 2


def least_slow_chi2(sums: np.ndarray, plain: np.ndarray, c, s, shift, yy, phases: int = 20) -> np.ndarray:
    """Over the reference, the least weighted residuals of unweighted linear fits over all phases; NaN where no fit is defined.

    sums are weighted, plain those of unit errors, each with its own mean of y taken off; shift is the weighted mean
    less the plain one. shift and yy are numbers or one a row.
    """
    h, n = len(c), len(sums)
    shift, yy = (np.broadcast_to(np.asarray(x, float), n)[:, None] for x in (shift, yy))
    yy = np.where(yy > 0, yy, np.nan)
    size = max(phases, 12 * h)
    values = slow_chi2_polynomials(sums, plain, c, s, size)
    polynomials = [Harmonics(x, degree) for x, degree in zip(values, (h, 2 * h, h, h, 2 * h))]

    def chi2(theta: np.ndarray) -> np.ndarray:
        turns = waves(theta, 2 * h)
        return slow_chi2([x.value(turns) for x in polynomials], shift, yy) / yy

    p = slow_chi2(values, shift, yy) / yy
    held = np.where((p <= np.roll(p, 1, axis=1)) & (p <= np.roll(p, -1, axis=1)), p, np.inf)
    best = np.argsort(held, axis=1, kind="stable")[:, :PEAKS]
    at = 2 * np.pi * best / size
    lo, hi = at - 2 * np.pi / size, at + 2 * np.pi / size
    gold = (np.sqrt(5) - 1) / 2
    x, y = hi - gold * (hi - lo), lo + gold * (hi - lo)
    px, py = chi2(x), chi2(y)
    for _ in range(36):
        left = px <= py
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
        new = np.where(left, hi - gold * (hi - lo), lo + gold * (hi - lo))
        pn = chi2(new)
        x, y, px, py = np.where(left, new, y), np.where(left, x, new), np.where(left, pn, py), np.where(left, px, pn)
    best = np.concatenate([px, py, np.take_along_axis(p, best[:, :1], axis=1)], axis=1)
    return np.where(np.isnan(best).all(axis=1), np.nan, np.nanmin(np.where(np.isnan(best), np.inf, best), axis=1))


def direct_slow_chi2(t: np.ndarray, w: np.ndarray, y: np.ndarray, times: np.ndarray, freqs: np.ndarray, c, s, phases: int) -> np.ndarray:
    """(freq, phases): ``slow_chi2`` at even phases from the observations themselves, times of each; no small variance is lost to a difference of sums."""
    out = np.empty((len(freqs), phases))
    v = shifted(np.asarray(c, float), np.asarray(s, float), 2 * np.pi * np.arange(phases) / phases)
    n = times.sum()
    dy = y - times @ y / n
    step = max(1, 400_000 // (phases * len(t)))
    for a in range(0, len(freqs), step):
        turns = np.outer(freqs[a : a + step], t)
        held = waves(2 * np.pi * (turns - np.floor(turns)), len(c))
        m = v @ np.stack([x[0] for x in held] + [x[1] for x in held], axis=1)
        m -= (m @ times / n)[:, :, None]
        own = (m * m) @ times
        slope = m @ (times * dy) / np.where(own > 1e-30 * n, own, np.nan)
        m *= -slope[:, :, None]
        m += dy
        m *= m
        out[a : a + step] = m @ w
    return out
