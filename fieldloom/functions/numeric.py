"""Numeric helpers without a Spark built-in: special functions, small solves. Plain numpy on one series or one small matrix."""

from __future__ import annotations

import math
from functools import cache
from itertools import accumulate

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's rule."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    """Probability that a Student t variable is at least as far from 0 as ``t``."""
    return 0.0 if math.isinf(t) else beta_inc(dof / 2, 0.5, dof / (dof + t * t))


@cache
def inversions(n: int) -> list[int]:
    """How many orders of ``n`` things have 0, 1, ... pairs in the wrong order."""
    counts = [1]
    for k in range(2, n + 1):
        upto = [0, *accumulate(counts)]
        counts = [upto[min(i + 1, len(counts))] - upto[max(0, i - k + 1)] for i in range(len(counts) + k - 1)]
    return counts


def tau_p_value(s: float, against: float, n: float, ties_x: float, ties_y: float, cubes_x: float, cubes_y: float, fifths_x: float, fifths_y: float) -> float:
    """Two-sided p-value of Kendall's tau: exact without ties up to 33 values, else by the normal approximation with ties.

    ``s`` is agreeing less opposing pairs; of each group of t tied values t(t-1)/2, t(t-1)(t-2) and t(t-1)(2t+5) are summed up.
    """
    total = n * (n - 1) / 2
    if not ties_x and not ties_y and n <= 33:
        few = int(min(against, total - against))
        return min(1.0, 2 * sum(inversions(int(n))[: few + 1]) / math.factorial(int(n)))
    spread = (n * (n - 1) * (2 * n + 5) - fifths_x - fifths_y) / 18 + ties_x * ties_y / total
    spread += cubes_x * cubes_y / (18 * total * (n - 2)) if n > 2 else 0.0
    return math.erfc(abs(s) / math.sqrt(2 * spread)) if spread > 0 else 1.0


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence to arguments of 8 or more and the asymptotic series; for positive x."""
    x, shift = np.array(x, float), np.zeros_like(np.asarray(x, float))
    while (low := x < 8).any():
        shift = shift - np.where(low, 1 / x, 0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x, shift = np.array(x, float), np.zeros_like(np.asarray(x, float))
    while (low := x < 8).any():
        shift = shift + np.where(low, 1 / (x * x), 0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return shift + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function, elementwise: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    x = np.maximum(x, 0)
    lgamma = np.vectorize(math.lgamma, otypes=[float])(a)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(a * np.log(x) - x - lgamma)
        term = 1 / a
        total, k = term.copy(), a.copy()
        for _ in range(2000):
            k = k + 1
            term = term * x / k
            total = total + term
            if (np.abs(term) <= 1e-16 * np.abs(total))[x < a + 1].all():
                break
        b = x + 1 - a
        c = np.full_like(a, 1e300)
        d = 1 / b
        h = d.copy()
        for i in range(1, 2000):
            f = -i * (i - a)
            b = b + 2
            d = 1 / (f * d + b)
            c = b + f / c
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15)[x >= a + 1].all():
                break
        out = np.where(x < a + 1, front * total, 1 - front * h)
    return np.where(x <= 0, 0.0, np.clip(out, 0, 1))


def gamma_mle(mean: np.ndarray, mean_log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shape, scale) of gamma distributions located at 0 with the largest likelihood, from means and mean logarithms."""
    s = np.maximum(np.log(mean) - mean_log, 1e-12)
    a = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(30):
        a = np.maximum(a - (np.log(a) - digamma(a) - s) / (1 / a - trigamma(a)), a / 10)
    return a, mean / a


def gaussian_smooth(values: np.ndarray, window: int, std: float) -> np.ndarray:
    """Centred Gaussian-weighted mean over present values, NaN where a window has none. Even windows reach one further back."""
    lags = np.arange(-(window // 2), (window + 1) // 2)
    weights = np.exp(-0.5 * ((lags + (0.5 if window % 2 == 0 else 0.0)) / std) ** 2)
    n, pad = len(values), len(lags)
    present = ~np.isnan(values)
    padded = lambda x: np.concatenate([np.zeros(pad), x, np.zeros(pad)])
    start = pad - window // 2
    sums = [np.convolve(padded(x), weights[::-1], "valid")[start : start + n] for x in (np.where(present, values, 0.0), present.astype(float))]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(sums[1] > 1e-300, sums[0] / sums[1], np.nan)


def points_in_rings(lon: np.ndarray, lat: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Whether points lie inside, by the even-odd rule over all rings (holes and parts alike)."""
    inside = np.zeros(len(lon), bool)
    for ring in rings:
        x1, y1 = ring[:, 0], ring[:, 1]
        for a, b, c, d in zip(x1, y1, np.roll(x1, -1), np.roll(y1, -1)):
            if b != d:
                crosses = (b > lat) != (d > lat)
                inside ^= crosses & (lon < (c - a) * (lat - b) / (d - b) + a)
    return inside


def _within(values: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """For each value how many values, itself included, lie closer than its ``reach``."""
    u, place, counts = np.unique(values, return_inverse=True, return_counts=True)
    upto, last = np.r_[0, np.cumsum(counts)], len(u) - 1
    near = lambda i: np.abs(u[np.clip(i, 0, last)] - values) < reach
    low, high = np.searchsorted(u, values - reach, "right"), np.searchsorted(u, values + reach, "left") - 1
    low, high = np.minimum(low, place), np.maximum(high, place)
    # The sums above are rounded; the differences decide.
    low = np.where((low > 0) & near(low - 1), low - 1, np.where((low < place) & ~near(low), low + 1, low))
    high = np.where((high < last) & near(high + 1), high + 1, np.where((high > place) & ~near(high), high - 1, high))
    return np.where(reach > 0, upto[high + 1] - upto[low], 0)


def _neighbour_reach(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Chebyshev distance of each point to its k-th neighbour; ``x`` is sorted, and windows of it widen until nothing outside is nearer."""
    n, reach, left, half = len(x), np.empty(len(x)), np.arange(len(x)), 32
    while left.size:
        size, open_ = min(n, 2 * half + 1), []
        step = max(1, (1 << 20) // size)
        for start in range(0, left.size, step):
            i = left[start : start + step]
            low = np.clip(i - half, 0, n - size)
            at = low[:, None] + np.arange(size)
            r = np.partition(np.maximum(np.abs(x[i, None] - x[at]), np.abs(y[i, None] - y[at])), k, axis=1)[:, k]
            edge = np.minimum(np.where(low > 0, x[i] - x[low], np.inf), np.where(low + size < n, x[low + size - 1] - x[i], np.inf))
            reach[i] = r
            open_.append(i[r > edge])
        left, half = np.concatenate(open_), 4 * half
    return reach


def knn_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Mutual information in nats by the nearest-neighbour estimator of Kraskov et al. (2004), not below 0.

    Distances are told apart to a billionth of the deviation, so that ties stay ties whatever the order of sums.
    """
    n = len(x)
    if n <= k + 1:
        return 0.0
    x, y = ((v - v.mean()) / (v.std() or 1.0) for v in (np.asarray(x, float), np.asarray(y, float)))
    if len(np.unique(y)) > len(np.unique(x)):  # the estimate is symmetric, and windows are short where values differ
        x, y = y, x
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    reach = _neighbour_reach(x, y, k)
    near = np.maximum(reach - 1e-9, 0)
    counts_x, counts_y = (_within(v, near) - (near > 0) for v in (x, y))
    value = digamma(np.array([float(k)]))[0] + digamma(np.array([float(n)]))[0] - (digamma(np.maximum(counts_x, 0) + 1) + digamma(np.maximum(counts_y, 0) + 1)).mean()
    return max(0.0, float(value))


def greedy_vif(corr: np.ndarray, order: list[int], limit: float = 5.0) -> list[int]:
    """Take features in order unless one of those taken would have a variance inflation factor above ``limit``."""
    taken: list[int] = []
    for i in order:
        trial = [*taken, i]
        matrix = corr[np.ix_(trial, trial)]
        if len(trial) > 1:
            if np.linalg.cond(matrix) > 1e12 or np.diag(np.linalg.inv(matrix)).max() > limit:
                continue
        taken = trial
    return taken


def lasso_weights(gram: np.ndarray, cross: np.ndarray, alpha: float, rounds: int = 1000) -> np.ndarray:
    """Coordinate descent on mean squares: minimises w'Gw / 2 - c'w + alpha |w|."""
    w = np.zeros(len(cross))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            if gram[j, j] > 0:
                rho = cross[j] - gram[j] @ w + gram[j, j] * w[j]
                w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / gram[j, j]
        if np.abs(w - before).max(initial=0.0) < 1e-10:
            break
    return w


def gp_predict(x: np.ndarray, t: np.ndarray, y: np.ndarray, x_new: np.ndarray, t_new: np.ndarray, sigma: float, l_s: float, l_t: float, noise: float) -> np.ndarray:
    """Gaussian-process mean with kernel sigma exp(-dx^2 / l_s^2) exp(-dt^2 / l_t^2) plus noise on the diagonal."""

    def kernel(a: np.ndarray, s: np.ndarray, b: np.ndarray, u: np.ndarray) -> np.ndarray:
        d = ((a[:, None] - b[None]) ** 2).sum(-1)
        return sigma * np.exp(-d / l_s**2) * np.exp(-((s[:, None] - u[None]) ** 2) / l_t**2)

    k = kernel(x, t, x, t) + noise * np.eye(len(x))
    lower = np.linalg.cholesky(k + 1e-10 * np.eye(len(x)))
    return kernel(x_new, t_new, x, t) @ np.linalg.solve(lower.T, np.linalg.solve(lower, y))
