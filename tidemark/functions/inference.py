"""Tail probabilities and small-sample tests on already aggregated numbers (tiny, driver side or inside a group)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return upper_gamma(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return 2 * NormalDist().cdf(-abs(z))


def holm(p: list[float], alpha: float = 0.05) -> list[tuple[float, float, bool]]:
    """(p, adjusted, rejected) by ascending p; adjusted values are not made monotone, rejection stops at the first failure."""
    out, open_ = [], True
    for k, x in enumerate(sorted(p)):
        open_ = open_ and x <= alpha / (len(p) - k)
        out.append((x, min(1.0, x * (len(p) - k)), open_))
    return out


def hp_trend(x: np.ndarray, penalty: float = 1.6e6) -> np.ndarray:
    """Trend that balances fit against squared second differences: a five-diagonal system, solved in time and memory linear in the rows."""
    n = len(x)
    if n < 3:
        return np.asarray(x, float).copy()
    main, one, two = np.ones(n), np.zeros(n), np.zeros(n)  # one[i], two[i]: entries (i, i + 1) and (i, i + 2)
    for at, c in ((0, 1.0), (1, -2.0), (2, 1.0)):
        main[at : n - 2 + at] += penalty * c * c
    one[: n - 2] += penalty * -2.0
    one[1 : n - 1] += penalty * -2.0
    two[: n - 2] += penalty
    y = np.asarray(x, float).copy()
    for i in range(n - 1):  # elimination; the matrix is positive definite
        for off, c in ((1, one[i]), (2, two[i])):
            if i + off < n and c:
                m = c / main[i]
                main[i + off] -= m * c
                if off == 1:
                    one[i + 1] -= m * two[i]
                y[i + off] -= m * y[i]
    for i in range(n - 1, -1, -1):
        y[i] -= (one[i] * y[i + 1] if i + 1 < n else 0) + (two[i] * y[i + 2] if i + 2 < n else 0)
        y[i] /= main[i]
    return y


def trend_so_far(x: np.ndarray, penalty: float = 1.6e6) -> np.ndarray:
    """For every row, what hp_trend of the rows so far gives for it: the filtered level of a local linear trend whose slope moves with variance 1 / penalty.

    One pass: the state is the trend at the last two rows. After two rows nothing is smoothed yet (the prior is diffuse), so it starts there, exactly.
    """
    x = np.asarray(x, float)
    out = x.copy()
    if len(x) < 3:
        return out
    a1, a2, p11, p12, p22, q = x[1], x[0], 1.0, 0.0, 1.0, 1.0 / penalty
    for t, y in enumerate(x[2:].tolist(), 2):
        ahead, v11, v12 = 2 * a1 - a2, 4 * p11 - 4 * p12 + p22 + q, 2 * p11 - p12
        k1, k2 = v11 / (v11 + 1), v12 / (v11 + 1)
        a1, a2, p11, p12, p22 = ahead + k1 * (y - ahead), a1 + k2 * (y - ahead), k1, k2, p11 - k2 * v12
        out[t] = a1
    return out


def hac_ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (constant first) and Newey-West standard errors with max(2, ceil(n ** 1/4)) lags."""
    a = np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.inv(a.T @ a)
    beta = inv @ a.T @ y
    u = a * (y - a @ beta)[:, None]
    lags = max(2, math.ceil(len(y) ** 0.25))
    s = u.T @ u
    for k in range(1, lags + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    return beta, np.sqrt(np.diag(inv @ s @ inv))


def wilcoxon_p(w: float, n: int, ties: bool = False) -> float:
    """Two-sided p of the smaller signed-rank sum w over n non-zero differences: exact by counting subsets to n = 50, else (or with ties) the normal limit."""
    if n == 0:
        return 1.0
    if n <= 50 and not ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] += ways[:-k].copy()
        return min(1.0, 2 * float(ways[: int(w) + 1].sum()) / 2.0**n)
    return normal_two_sided((w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24))


def deflated_sharpe(sharpe: float, trials: int, rows: int, skew: float, kurtosis: float) -> float:
    """Probability that a Sharpe ratio is above what the best of `trials` without skill would show. kurtosis: 3 for a normal."""
    if trials < 1 or rows < 2:
        return 0.0
    euler, inv = 0.5772156649, NormalDist().inv_cdf
    best = (1 - euler) * inv(1 - 1 / trials) + euler * inv(1 - 1 / (trials * math.e)) if trials > 1 else 0.0
    sd = math.sqrt(max((1 + 0.5 * sharpe**2 - skew * sharpe + (kurtosis - 1) / 4) / (rows - 1), 0.0))
    return NormalDist().cdf((sharpe - best) / sd) if sd >= 1e-12 else float(sharpe > best)


def bootstrap(statistic, columns: list[np.ndarray], times: int = 2000, seed: int = 42) -> tuple[float, float]:
    """2.5 and 97.5 percentiles of a statistic over rows drawn again with replacement."""
    rng, n = np.random.default_rng(seed), len(columns[0])
    got = []
    for _ in range(times):
        i = rng.integers(0, n, n)
        got.append(statistic(*(c[i] for c in columns)))
    lo, hi = np.nanpercentile(got, [2.5, 97.5])
    return float(lo), float(hi)


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks, from 1."""
    own, number, count = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    return (last - (count - 1) / 2)[number]


def spearman(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation of the ranks; NaN where either side is constant."""
    x, y = ranks(a), ranks(b)
    x, y = x - x.mean(), y - y.mean()
    size = math.sqrt((x @ x) * (y @ y))
    return float(x @ y / size) if size > 0 else float("nan")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by a continued fraction on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # 1 / (1 + d1 x / (1 + d2 x / ...)) from its far end
    value = 1.0
    for k in range(400, 0, -1):
        m = k // 2
        d = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + d * x / value
    return front / value


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def mann_whitney_p(u: float, n: int, m: int) -> float:
    """Two-sided p of U by the normal limit, moved half a step towards the middle."""
    middle, sd = n * m / 2, math.sqrt(n * m * (n + m + 1) / 12)
    return min(1.0, normal_two_sided(max(abs(u - middle) - 0.5, 0.0) / sd)) if sd > 0 else 1.0
