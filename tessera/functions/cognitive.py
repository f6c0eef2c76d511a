"""Small dense kernels in numpy: LASSO residuals (FISTA), diverse subsets (DPP), matrix factorisation (NMF). They work on a few hundred rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def fista(query: np.ndarray, entities: np.ndarray, lam: float = 0.1, iterations: int = 80) -> tuple[np.ndarray, np.ndarray, float]:
    """min 1/2 |q - a E|^2 + lam |a|_1 by accelerated proximal gradient: a, the residual q - a E, its norm. Rows of E are entities."""
    q, e = np.asarray(query, float), np.atleast_2d(np.asarray(entities, float))
    if not len(e):
        return np.zeros(0), q, float(np.linalg.norm(q))
    gram, target = e @ e.T, e @ q
    bound = np.abs(gram).sum(axis=1).max()  # Gershgorin: no eigenvalue is above
    step = 1 / bound if bound > 0 else 1.0
    a = y = np.zeros(len(e))
    t = 1.0
    for _ in range(iterations):
        z = y - step * (gram @ y - target)
        new = np.sign(z) * np.maximum(np.abs(z) - step * lam, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - a)
        a, t = new, t_new
    residual = q - a @ e
    return a, residual, float(np.linalg.norm(residual))


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = np.atleast_2d(np.asarray(v, float))
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def dpp_select(vectors: np.ndarray, scores: np.ndarray, k: int, weight: float = 1.0) -> list[int]:
    """Greedy MAP of a determinantal point process with kernel q_i cos_ij q_j, q = max(score, 1e-10)^weight. Ties go to the first row."""
    if not len(scores) or k <= 0:
        return []
    u = unit_rows(vectors)
    q = np.maximum(np.asarray(scores, float), 1e-10) ** weight
    gain = (u * u).sum(axis=1) * q * q
    rows = np.zeros((min(k, len(q)), len(q)))
    chosen: list[int] = []
    while len(chosen) < min(k, len(q)):
        open_gain = gain.copy()
        open_gain[chosen] = -np.inf
        j = int(np.argmax(open_gain))
        if open_gain[j] <= 1e-12:
            break
        n = len(chosen)
        rows[n] = (q[j] * q * (u @ u[j]) - rows[:n, j] @ rows[:n]) / np.sqrt(gain[j])
        gain = gain - rows[n] ** 2
        chosen.append(j)
    return chosen


#: Start values of factorisations: a 64-bit linear congruential generator. Fixed values.
LCG_SEED, LCG_FACTOR, LCG_STEP = 42, 6364136223846793005, 1


def lcg(n: int) -> np.ndarray:
    """The generator's first n numbers, by their upper 31 bits, as parts of 2^32 - 1."""
    out, x = np.empty(n), LCG_SEED
    for i in range(n):
        x = (x * LCG_FACTOR + LCG_STEP) & 0xFFFFFFFFFFFFFFFF
        out[i] = (x >> 33) / 0xFFFFFFFF
    return out


def nmf(v: np.ndarray, k: int, iterations: int = 200, tol: float = 1e-4, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """|V| = W H with non-negative factors, by multiplicative updates; the error is looked at every 10 rounds. Start values lie around the root of V's mean
    over k."""
    v = np.abs(np.asarray(v, float))
    if start is None:
        m, d = v.shape
        mean = max(math.sqrt(v.mean() / k), 0.01)
        both = np.abs(mean + mean * 0.5 * (lcg((m + d) * k) - 0.5)) + 1e-10
        start = both[: m * k].reshape(m, k), both[m * k :].reshape(k, d)
    w, h = (x.copy() for x in start)
    before = np.inf
    for n in range(1, iterations + 1):
        h *= (w.T @ v) / np.maximum(w.T @ w @ h, 1e-10)
        w *= (v @ h.T) / np.maximum(w @ (h @ h.T), 1e-10)
        if n % 10 == 0:
            error = float(np.linalg.norm(v - w @ h))
            if abs(before - error) < tol * max(before, 1e-10) and np.isfinite(before):
                break
            before = error
    return w, h


@dataclass
class QueryTopics:
    topics: np.ndarray  # softmax of |q| on the topics
    depth: float  # 1 - entropy / ln k
    coverage: int  # topics above half of an equal share
    novelty: float  # the part of |q| that the topics, weighted like this, don't make up; at most 1


def analyse_query(query: np.ndarray, h: np.ndarray) -> QueryTopics:
    q = np.abs(np.asarray(query, float))
    k = len(h)
    weights = h @ q
    p = np.exp(weights - weights.max())
    p /= p.sum()
    entropy = -float((p[p > 1e-10] * np.log(p[p > 1e-10])).sum())
    left = np.linalg.norm(q - p @ h) / max(np.linalg.norm(q), 1e-10)
    return QueryTopics(p, 1 - entropy / (math.log(k) if k > 1 else 1.0), int((p > 0.5 / k).sum()), float(min(1.0, left)))
