"""Planning arithmetic and small models, on the driver: retention, surrogates, knowledge."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def normal_pdf(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of normal_cdf by bisection on a bracket that holds all doubles strictly between 0 and 1."""
    if not 0 < p < 1:
        raise ValueError("p must be strictly between 0 and 1")
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def retention(rho: float, keep: float, active: float, steps: int = 4000) -> float:
    """Share of actives among the kept under a bivariate normal score of correlation rho.

    Without correlation that is ``keep``; with a perfect one min(1, keep / active).
    """
    if rho <= 0:
        return keep
    if rho >= 1:
        return min(1.0, keep / active)
    if keep >= 1:
        return 1.0
    tau, start = normal_quantile(1 - keep), normal_quantile(1 - active)
    t = np.linspace(start, max(start + 12.0, 10.0), steps + 1)
    inside = np.array([normal_pdf(x) * normal_cdf((rho * x - tau) / math.sqrt(1 - rho * rho)) for x in t])
    return float(min(1.0, np.trapezoid(inside, t) / active))


def rho_for_multiplier(base_rho: float, multiplier: float, keep: float, active: float) -> float:
    """The correlation whose retention is ``multiplier`` times that of ``base_rho``; 1 where none reaches it."""
    goal = multiplier * retention(base_rho, keep, active)
    if goal >= retention(1.0, keep, active):
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if retention(mid, keep, active) < goal else (lo, mid)
    return (lo + hi) / 2


def gaussian_process(pool: np.ndarray, seen: Sequence[int], values: Sequence[float], noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and spread at every pool row.

    Features are standardised over the pool; the kernel is exp(-d2 / 2 / l2), d2 divided by the number of features and
    l2 the median positive d2 among up to 128 pool rows. Values are standardised, too.
    """
    x = (pool - pool.mean(0)) / np.where(pool.std(0) > 0, pool.std(0), 1.0)
    d2 = lambda a, b: ((a[:, None, :] - b[None, :, :]) ** 2).sum(2) / x.shape[1]
    some = d2(x[:128], x[:128])
    l2 = float(np.median(some[some > 0])) if (some > 0).any() else 1.0
    y = np.asarray(values, float)
    mean, scale = (float(y.mean()), float(y.std()) or 1.0) if len(y) else (0.0, 1.0)
    if not len(y):
        return np.zeros(len(x)), np.ones(len(x))
    k = np.exp(-d2(x[list(seen)], x[list(seen)]) / 2 / l2) + noise * np.eye(len(y))
    across = np.exp(-d2(x, x[list(seen)]) / 2 / l2)
    mu = across @ np.linalg.solve(k, (y - mean) / scale)
    var = 1 - np.einsum("ij,ji->i", across, np.linalg.solve(k, across.T))
    return mean + scale * mu, scale * np.sqrt(np.maximum(var, 0.0))


def savitzky_golay(values: Sequence[float], window: int, order: int) -> np.ndarray:
    """Least-squares polynomial smoothing with an odd window; the ends use the first and last window's fit."""
    if window % 2 == 0 or order >= window:
        raise ValueError("window must be odd and larger than the order")
    y = np.asarray(values, float)
    if len(y) < window:
        return y.copy()
    half = window // 2
    at = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(at, order + 1, increasing=True))
    out = np.convolve(y, fit[0][::-1], mode="same")
    for ends, part in ((range(half), y[:window]), (range(len(y) - half, len(y)), y[-window:])):
        coef = fit @ part
        centre = half if ends[0] == 0 else len(y) - 1 - half
        for i in ends:
            out[i] = sum(c * (i - centre) ** p for p, c in enumerate(coef))
    return out


def bootstrap(values: Sequence[float], rounds: int, seed: int) -> tuple[float, float]:
    """Mean and spread of the means of resampled values."""
    rng = np.random.default_rng(seed)
    y = np.asarray(values, float)
    means = rng.choice(y, (rounds, len(y))).mean(1)
    return float(means.mean()), float(means.std(ddof=1))


def merge_json(base, update):
    """Recursive merge of objects; anything else is replaced."""
    if isinstance(base, dict) and isinstance(update, dict):
        return {**base, **{k: merge_json(base[k], v) if k in base else v for k, v in update.items()}}
    return update


def at_pointer(value, pointer: str):
    """The member that a JSON pointer names."""
    for part in pointer.split("/")[1:]:
        name = part.replace("~1", "/").replace("~0", "~")
        value = value[int(name)] if isinstance(value, list) else value[name]
    return value
