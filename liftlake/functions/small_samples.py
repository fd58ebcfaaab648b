"""NumPy helpers for facts rows and bounded groups.

Everything here sees either one facts row per comparison or a group whose size
the caller has bounded; unit tables never pass through.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np

_ND = NormalDist()


# --- Shapiro-Wilk (Royston 1995) ------------------------------------------
# Polynomial coefficients of the published approximation.
_C1 = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0]
_C2 = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
_G = [0.459, -2.273]
_MU_SMALL = [-0.0006714, 0.025054, -0.39978, 0.5440]
_SD_SMALL = [-0.0020322, 0.062767, -0.77857, 1.3822]
_MU_LARGE = [0.0038915, -0.083751, -0.31082, -1.5861]
_SD_LARGE = [0.0030302, -0.082676, -0.4803]


@lru_cache(maxsize=256)
def _normal_scores(n: int) -> np.ndarray:
    return np.array([_ND.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and its p-value for 3 ≤ n ≤ 5000."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3:
        return math.nan, math.nan
    centred = x - x.mean()
    total = float(centred @ centred)
    if total <= 0:
        return 1.0, 1.0
    m = _normal_scores(n)
    a = np.zeros(n)
    if n == 3:
        a[-1], a[0] = math.sqrt(0.5), -math.sqrt(0.5)
    else:
        ss = float(m @ m)
        u = 1.0 / math.sqrt(n)
        last = np.polyval(_C1, u) + m[-1] / math.sqrt(ss)
        if n > 5:
            second = np.polyval(_C2, u) + m[-2] / math.sqrt(ss)
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[-1], a[0] = last, -last
    w = min(1.0, float(a @ centred) ** 2 / total)
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(0.0, p)
    y = math.log(max(1.0 - w, 1e-300))
    if n <= 11:
        gamma = np.polyval(_G, n)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mean, sd = np.polyval(_MU_SMALL, n), math.exp(np.polyval(_SD_SMALL, n))
    else:
        ln = math.log(n)
        mean, sd = np.polyval(_MU_LARGE, ln), math.exp(np.polyval(_SD_LARGE, ln))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2.0))


# --- exact Mann-Whitney ----------------------------------------------------
def mann_whitney_exact(n1: int, n2: int, u: float) -> float:
    """Two-sided exact p of U for tie-free arms, from the counts of orderings with U up to the observed one.

    The counts are the coefficients of Π (1 − x^(n2+i)) / (1 − x^i), one factor per unit of the smaller arm. U is symmetric,
    so the smaller tail is enough: at most half of the coefficients, worked on in place.
    """
    n1, n2 = (n1, n2) if n1 <= n2 else (n2, n1)
    size = int(math.floor(min(u, n1 * n2 - u) + 1e-9)) + 1
    counts = np.zeros(size)
    counts[0] = 1.0
    for i in range(1, n1 + 1):
        if n2 + i < size:
            counts[n2 + i :] -= counts[: size - n2 - i]
        for start in range(min(i, size)):
            np.cumsum(counts[start::i], out=counts[start::i])
    return float(min(1.0, 2.0 * counts.sum() / math.comb(n1 + n2, n1)))


# --- noncentral t power ----------------------------------------------------
_U, _WEIGHTS = np.polynomial.legendre.leggauss(80)
_STEP = 1e-3
_GRID = np.arange(-12.0, 12.0 + _STEP, _STEP)
_TAIL = np.array([0.5 * math.erfc(z / math.sqrt(2.0)) for z in _GRID])
_SLOPE = -np.exp(-_GRID * _GRID / 2.0) / math.sqrt(2.0 * math.pi)


def _upper(z: np.ndarray) -> np.ndarray:
    """P(Z > z), cubic Hermite between tabulated values (error below 1e-14)."""
    x = np.clip(z, -11.99, 11.99)
    i = ((x - _GRID[0]) / _STEP).astype(int)
    u = (x - _GRID[i]) / _STEP
    h00, h10 = (1 + 2 * u) * (1 - u) ** 2, u * (1 - u) ** 2
    h01, h11 = u * u * (3 - 2 * u), u * u * (u - 1)
    return h00 * _TAIL[i] + h10 * _STEP * _SLOPE[i] + h01 * _TAIL[i + 1] + h11 * _STEP * _SLOPE[i + 1]


def _chi_scale(df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and probability weights of s = √(χ²_df / df), one row per df."""
    half = 9.0 / np.sqrt(2.0 * df)
    lo, hi = np.maximum(0.0, 1.0 - half), 1.0 + half + 3.0 / df
    s = lo[:, None] + (hi - lo)[:, None] * (_U[None, :] + 1.0) / 2.0
    d = df[:, None]
    with np.errstate(divide="ignore"):
        log_density = (d - 1.0) * np.log(np.maximum(s, 1e-300)) - d * (s * s - 1.0) / 2.0
    w = np.exp(log_density - log_density.max(axis=1, keepdims=True)) * _WEIGHTS
    return s, w / w.sum(axis=1, keepdims=True)


def t_tail_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    s, w = _chi_scale(df)
    return 2.0 * (w * _upper(np.abs(t)[:, None] * s)).sum(axis=1)


def t_critical(df: np.ndarray, alpha: float) -> np.ndarray:
    """Two-sided critical value by bisection on the tail."""
    lo, hi = np.zeros_like(df), np.full_like(df, 1.0)
    while np.any(t_tail_two_sided(hi, df) > alpha):
        hi = np.where(t_tail_two_sided(hi, df) > alpha, hi * 2.0, hi)
    for _ in range(36):
        mid = (lo + hi) / 2.0
        above = t_tail_two_sided(mid, df) > alpha
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return (lo + hi) / 2.0


def t_power(effect: np.ndarray, n1: np.ndarray, n2: np.ndarray, alpha: float, critical=None) -> np.ndarray:
    """Two-sided two-sample t power for a standardized effect."""
    df = n1 + n2 - 2.0
    ncp = effect * np.sqrt(n1 * n2 / (n1 + n2))
    c = t_critical(df, alpha) if critical is None else critical
    s, w = _chi_scale(df)
    up = _upper(c[:, None] * s - ncp[:, None])
    down = _upper(c[:, None] * s + ncp[:, None])
    return (w * (up + down)).sum(axis=1)


def t_minimum_effect(n1: np.ndarray, n2: np.ndarray, alpha: float, power: float) -> np.ndarray:
    """The standardized effect detected with the target power."""
    critical = t_critical(n1 + n2 - 2.0, alpha)
    lo, hi = np.zeros_like(n1), 60.0 / np.sqrt(n1 * n2 / (n1 + n2))
    for _ in range(60):
        mid = (lo + hi) / 2.0
        short = t_power(mid, n1, n2, alpha, critical) < power
        lo, hi = np.where(short, mid, lo), np.where(short, hi, mid)
    return (lo + hi) / 2.0


def t_required_n(effect: np.ndarray, ratio: np.ndarray, alpha: float, power: float) -> np.ndarray:
    """Real-valued first-arm size reaching the target power, by secant steps from the normal answer."""
    x = _ND.inv_cdf(1 - alpha / 2) + _ND.inv_cdf(power)
    floor = 1.01 + 1.0 / ratio

    def miss(n: np.ndarray) -> np.ndarray:
        return t_power(effect, n, n * ratio, alpha) - power

    a = np.maximum((x / effect) ** 2 * (1.0 + 1.0 / ratio), floor)
    b = a + 1.0
    fa, fb = miss(a), miss(b)
    for _ in range(12):
        slope = (fb - fa) / np.where(b == a, 1.0, b - a)
        move = np.where(np.abs(slope) > 1e-300, fb / np.where(slope == 0, 1.0, slope), 0.0)
        c = np.maximum(b - np.clip(move, -b, b / 2.0), floor)
        a, fa, b = b, fb, c
        if np.all(np.abs(a - b) < 1e-9 * b):
            break
        fb = miss(b)
    return b


# --- resampled medians -----------------------------------------------------
def resampled_median_positions(n: int, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Zero-based positions in the ordered sample that bootstrap medians take: draws x 1, or x 2 for an even ``n``.

    The k-th smallest of n resampled values is the sample quantile at U(k), the k-th uniform order
    statistic, which is Beta(k, n−k+1): drawing U(k) replaces drawing n values.
    """
    k = (n + 1) // 2
    u = rng.beta(k, n - k + 1, size=draws)[:, None]
    if n % 2 == 0:
        u = np.hstack([u, u + (1.0 - u) * (1.0 - rng.random((draws, 1)) ** (1.0 / (n - k)))])
    return np.clip(np.ceil(u * n).astype(np.int64) - 1, 0, n - 1)
