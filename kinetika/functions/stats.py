"""Distributions and tests from the standard library alone."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def binomial_pmf(n: int, p: float) -> np.ndarray:
    """Probabilities of 0 .. n successes."""
    if p <= 0 or p >= 1:
        out = np.zeros(n + 1)
        out[n if p >= 1 else 0] = 1.0
        return out
    k = np.arange(n + 1)
    logs = np.array([math.lgamma(i + 1) for i in range(n + 1)])
    return np.exp(logs[n] - logs - logs[::-1] + k * math.log(p) + (n - k) * math.log1p(-p))


def binomial_sf(k: int, n: int, p: float) -> float:
    """P(X > k)."""
    return float(min(1.0, binomial_pmf(n, p)[max(k + 1, 0) :].sum())) if k < n else 0.0


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k)."""
    return float(min(1.0, binomial_pmf(n, p)[: k + 1].sum())) if k >= 0 else 0.0


def _bisect(rises, goal: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if rises(middle) < goal else (low, middle)
    return (low + high) / 2


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """The exact confidence interval of a proportion."""
    low = 0.0 if k == 0 else _bisect(lambda p: binomial_sf(k - 1, n, p), alpha / 2)
    high = 1.0 if k == n else _bisect(lambda p: 1 - binomial_cdf(k, n, p), 1 - alpha / 2)
    return low, high


def chi2_sf_1(x: float) -> float:
    """The upper tail of chi-squared with one degree of freedom."""
    return math.erfc(math.sqrt(x / 2))


def normal_ppf(q: float) -> float:
    return NormalDist().inv_cdf(q)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def average_linkage(distance: np.ndarray) -> np.ndarray:
    """Average-linkage merges of a distance matrix: rows of two cluster numbers, height and size."""
    n = len(distance)
    d = np.array(distance, float)
    np.fill_diagonal(d, np.inf)
    size, number, alive = np.ones(n), list(range(n)), np.ones(n, bool)
    out = np.zeros((max(n - 1, 0), 4))
    for step in range(n - 1):
        i, j = sorted(divmod(int(np.argmin(np.where(alive[:, None] & alive[None, :], d, np.inf))), n))
        out[step] = (*sorted((number[i], number[j])), d[i, j], size[i] + size[j])
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i], d[i, i] = merged, merged, np.inf
        size[i] += size[j]
        alive[j], number[i] = False, n + step
    return out


def cut(linkage: np.ndarray, n: int, height: float) -> np.ndarray:
    """Cluster numbers from 1, in the order of their first members, after the merges up to ``height``."""
    members = {i: [i] for i in range(n)}
    for step, (a, b, h, _) in enumerate(linkage):
        if h <= height:
            members[n + step] = members.pop(int(a)) + members.pop(int(b))
        else:
            break
    out = np.zeros(n, int)
    for number, group in enumerate(sorted(members.values(), key=min), 1):
        out[group] = number
    return out


def cophenetic(linkage: np.ndarray, n: int) -> np.ndarray:
    """The height at which each pair is first joined."""
    members, out = {i: [i] for i in range(n)}, np.zeros((n, n))
    for step, (a, b, h, _) in enumerate(linkage):
        left, right = members.pop(int(a)), members.pop(int(b))
        out[np.ix_(left, right)] = h
        out[np.ix_(right, left)] = h
        members[n + step] = left + right
    return out
