"""Generators, scores and strategies on matrices: what experiments run in a task, one graph pair a trial."""

from __future__ import annotations

import numpy as np

from . import bfs


def correlated(p: np.ndarray, rho: float, rng: np.random.Generator, directed: bool = False, loops: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Two 0/1 matrices with chances p and correlation rho, place by place."""
    a = rng.random(p.shape) < p
    b = rng.random(p.shape) < np.where(a, p + rho * (1 - p), p * (1 - rho))
    keep = np.ones(p.shape, bool) if directed else np.triu(np.ones(p.shape, bool))
    if not loops:
        np.fill_diagonal(keep, False)
    a, b = a & keep, b & keep
    return ((a, b) if directed else (a | a.T, b | b.T))


def shuffled(a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b with its vertices in a random order, and where each of them went."""
    order = rng.permutation(len(b))
    return a.astype(np.int8), b[np.ix_(order, order)].astype(np.int8), np.argsort(order)


def er(rng, n=600, p=0.2, rho=0.5):
    return shuffled(*correlated(np.full((n, n), float(p)), rho, rng), rng)


def sbm(rng, n_per_block=200, n_blocks=3, rho=0.5, block_probs=((0.7, 0.3, 0.4), (0.3, 0.7, 0.3), (0.4, 0.3, 0.7))):
    of = np.repeat(np.arange(n_blocks), n_per_block)
    return shuffled(*correlated(np.asarray(block_probs, float)[np.ix_(of, of)], rho, rng), rng)


def powerlaw(rng, n=600, alpha=2.5, rho=0.8, p=0.0):
    w = rng.pareto(alpha, n) + 2
    if w.max() ** 2 / w.sum() > 1:
        w *= np.sqrt(w.sum()) / w.max() * 0.95
    return shuffled(*correlated(np.clip(np.outer(w, w) / w.sum() + p, 0, 1), rho, rng), rng)


def paper(rng, n=600, alpha=2.5, rho=0.8, p=0.01):
    return powerlaw(rng, n, alpha, rho, p)


def top(score: np.ndarray, k: int) -> np.ndarray:
    """The k largest; ties go to the smaller id."""
    return np.lexsort((np.arange(len(score)), -np.round(score, 9)))[: max(k, 0)]


def degree(a):
    return a.sum(1).astype(float)


def neighbor_degree(a):
    return a.astype(float) @ degree(a)


def triangles(a):
    f = a.astype(float)
    return ((f @ f) * f).sum(1) / 2


def triangle_ratio(a):
    return degree(a) / (triangles(a) + 1)


def mean_jaccard(a):
    f, d = a.astype(float), degree(a)
    common = f @ f
    share = f * common / np.maximum(d[:, None] + d[None, :] - common, 1)
    return share.sum(1) / np.maximum(d, 1)


def betweenness(a):
    """Each vertex's share of all shortest paths; where edges are many, from all sources at once by matrix products."""
    n = len(a)
    if a.sum() < n * n / 40:
        src, dst = np.nonzero(a)
        return bfs.Graph(np.arange(n), src, dst).dependencies(np.arange(n))
    f = a.astype(float)
    sigma, dist, d = np.eye(n), np.where(np.eye(n) > 0, 0, -1), 0
    while True:
        step = f.T @ np.where(dist == d, sigma, 0)  # a column a source
        new = (dist < 0) & (step > 0)
        if not new.any():
            break
        d += 1
        dist[new], sigma[new] = d, step[new]
    delta, safe = np.zeros((n, n)), np.maximum(sigma, 1)
    for level in range(d, 0, -1):
        back = f @ np.where(dist == level, (1 + delta) / safe, 0)
        here = dist == level - 1
        delta[here] += (sigma * back)[here]
    np.fill_diagonal(delta, 0)
    return delta.sum(1)


def embedding(a: np.ndarray, dims: int = 10) -> np.ndarray:
    """Laplacian eigenmaps: the normalised Laplacian's next dims vectors, over the root of the degrees."""
    f = a.astype(float)
    np.fill_diagonal(f, 0)
    d = f.sum(1)
    root = np.sqrt(np.where(d > 0, d, 1))
    lap = np.eye(len(a)) * (d > 0) - f / root[:, None] / root[None, :]
    _, vectors = np.linalg.eigh(lap)
    return vectors[:, 1 : dims + 1] / root[:, None]


def uniqueness(points: np.ndarray) -> np.ndarray:
    """Distance to the nearest other point."""
    square = (points**2).sum(1)
    d = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * points @ points.T, 0))
    np.fill_diagonal(d, np.inf)
    return d.min(1, initial=np.inf)


def spectral_unique(a):
    return uniqueness(embedding(a))


def blocked_random(a, k, rng, n_blocks=3):
    n = len(a)
    parts = np.array_split(np.arange(n), n_blocks)
    own = np.concatenate([rng.permutation(p)[: k // n_blocks] for p in parts]) if k else np.empty(0, int)
    rest = np.setdiff1d(np.arange(n), own)
    return np.concatenate([own, rng.permutation(rest)[: max(k, 0) - len(own)]]).astype(int)


def blocked_highest_degree(a, k, rng, n_blocks=3):
    d = degree(a)
    parts = np.array_split(np.arange(len(a)), n_blocks)
    return np.concatenate([p[top(d[p], k // n_blocks + (b < k % n_blocks))] for b, p in enumerate(parts)]).astype(int)
