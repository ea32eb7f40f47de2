"""Generators, strategies and algorithms by name. Experiments name them; new ones are added with register()."""

from __future__ import annotations

from collections.abc import Callable

from pairloom.kernels import graphs, matching

GENERATORS: dict[str, Callable] = {"er": graphs.er, "sbm": graphs.sbm, "powerlaw": graphs.powerlaw, "paper": graphs.paper}


def scored(score: Callable) -> Callable:
    return lambda a, k, rng, **_: graphs.top(score(a), k) if k > 0 else graphs.top(graphs.degree(a), 0)


#: (matrix, k, rng, n_blocks=) -> vertices of A, best first
STRATEGIES: dict[str, Callable] = {
    "random_seeds": lambda a, k, rng, **_: rng.permutation(len(a))[: max(k, 0)],
    "highest_degree_seeds": scored(graphs.degree),
    "blocked_random_seeds": graphs.blocked_random,
    "blocked_highest_degree_seeds": graphs.blocked_highest_degree,
    "betweenness_seeds": scored(graphs.betweenness),
    "spectral_unique_seeds": scored(graphs.spectral_unique),
    "neighbor_degree_seeds": scored(graphs.neighbor_degree),
    "jaccard_neighborhood_seeds": scored(graphs.mean_jaccard),
    "triangle_degree_ratio_seeds": scored(graphs.triangle_ratio),
}

#: (A, B, seeds) -> B's vertex for each of A's
ALGORITHMS: dict[str, Callable] = {
    "percolation": lambda a, b, seeds: matching.percolate(a, b, seeds),
    "percolation_no_expansion": lambda a, b, seeds: matching.percolate(a, b, seeds, expand=False),
    "sgm": lambda a, b, seeds: matching.seeded_match(a, b, seeds)[0],
}


def register(kind: dict[str, Callable], name: str, f: Callable) -> None:
    if name in kind:
        raise ValueError(f"{name} is registered already")
    kind[name] = f
