"""Isolation forests over small integer feature codes, grown for all trees at once."""

from __future__ import annotations

import numpy as np


def _c(n: np.ndarray) -> np.ndarray:
    """The mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    out[big] = 2 * (np.log(n[big] - 1) + 0.5772156649015329) - 2 * (n[big] - 1) / n[big]
    return out


def forest_scores(x: np.ndarray, weight: np.ndarray, seed: int, trees: int = 32, sample: int = 64) -> np.ndarray:
    """Anomaly scores in (0, 1) of the distinct points ``x`` (n, features), each standing for ``weight`` readings.

    Each tree is grown on ``sample`` points drawn in proportion to the roots of the weights. All readings count, but
    a description that is one in a million still gets into some trees; drawn uniformly it would be in none, and be
    scored like the ordinary reading nearest to it. Equal inputs and seeds give equal scores.
    """
    rng = np.random.default_rng(seed)
    n, width = x.shape
    psi = int(min(sample, weight.sum()))
    limit = max(1, int(np.ceil(np.log2(max(psi, 2)))))
    root = np.sqrt(weight)
    grown = x[rng.choice(n, (trees, psi), p=root / root.sum())].reshape(-1, width)
    base = np.arange(trees)
    tree_of = np.repeat(base, psi)
    at_s, at_q = np.zeros(trees * psi, int), np.zeros((trees, n), int)
    path, alive = np.zeros((trees, n)), np.ones((trees, n), bool)
    cols = np.arange(n)[None, :]
    for depth in range(limit + 1):
        k = 1 << depth
        key = tree_of * k + at_s
        size = np.bincount(key, minlength=trees * k)
        feature = np.full(trees * k, -1)
        threshold = np.zeros(trees * k)
        if depth < limit:
            order = np.argsort(key, kind="stable")
            ks, xs = key[order], grown[order]
            starts = np.flatnonzero(np.r_[True, ks[1:] != ks[:-1]])
            low, high = np.minimum.reduceat(xs, starts), np.maximum.reduceat(xs, starts)
            span = high - low
            pick = np.argmax((rng.random(span.shape) + 1e-9) * (span > 0), axis=1)
            rows = np.arange(len(starts))
            cut = low[rows, pick] + rng.random(len(starts)) * span[rows, pick]
            ids = ks[starts]
            feature[ids] = np.where(span[rows, pick] > 0, pick, -1)
            threshold[ids] = cut
        at = base[:, None] * k + at_q
        f = feature[at]
        stop = alive & (f < 0)
        path[stop] = depth + _c(size[at[stop]])
        alive &= f >= 0
        if depth == limit or not alive.any():
            break
        at_q = 2 * at_q + (x[cols, np.maximum(f, 0)] > threshold[at])
        fs = feature[key]
        at_s = 2 * at_s + ((grown[np.arange(len(key)), np.maximum(fs, 0)] > threshold[key]) & (fs >= 0))
    return np.exp2(-path.mean(axis=0) / max(float(_c(np.array([psi]))[0]), 1.0))
