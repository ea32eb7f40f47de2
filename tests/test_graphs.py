"""Scores and strategies against hand-computed values and the matrix twins."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.kernels import graphs, lap, matching
from pairloom.operators import percolation, scores, seeds
from pairloom.sources import generate

PAIRS = [(0, 1), (0, 2), (1, 2), (2, 3)]  # vertex 4 stands alone


@pytest.fixture(scope="module")
def micro(spark):
    both = PAIRS + [(b, a) for a, b in PAIRS]
    return spark.range(5), spark.createDataFrame(both, "src bigint, dst bigint")


def values(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


def test_scores_by_hand(micro):
    v, e = micro
    assert values(scores.degree(v, e), "degree") == [2, 2, 3, 1, 0]
    assert values(scores.neighbor_degree(v, e), "neighbor_degree") == [5, 5, 5, 3, 0]
    assert values(scores.triangles(v, e), "triangles") == [1, 1, 1, 0, 0]
    assert values(scores.triangle_degree_ratio(v, e), "ratio") == [1.0, 1.0, 1.5, 1.0, 0.0]
    assert values(scores.jaccard_neighborhood(v, e), "jaccard") == pytest.approx([7 / 24, 7 / 24, 1 / 6, 0, 0])
    assert values(scores.betweenness(v, e), "betweenness") == pytest.approx([0, 0, 1 / 3, 0, 0])
    assert values(scores.adjacency_list(v, e), "neighbors") == [[1, 2], [0, 2], [0, 1, 3], [2], []]


def test_seeds_by_hand(micro):
    v, e = micro
    truth = v.selectExpr("id a", "(id + 1) % 5 b")
    take = lambda df: [(r.a, r.b) for r in df.orderBy("seed_rank").collect()]
    assert take(seeds.highest_degree(v, e, 2, truth)) == [(2, 3), (0, 1)]
    assert take(seeds.neighbor_degree(v, e, 2, truth)) == [(0, 1), (1, 2)]
    assert take(seeds.triangle_ratio(v, e, 2, truth)) == [(2, 3), (0, 1)]
    assert take(seeds.jaccard(v, e, 2, truth)) == [(0, 1), (1, 2)]
    assert take(seeds.betweenness(v, e, 2, truth)) == [(2, 3), (0, 1)]
    assert take(seeds.highest_degree(v, e, 0, truth)) == []
    assert len(take(seeds.random(v, 5, truth))) == 5
    blocks = v.selectExpr("id", "cast(id >= 3 as int) block")
    assert take(seeds.blocked_random(blocks, 0, truth, 2)) == []
    assert [a for a, _ in take(seeds.blocked_highest_degree(blocks, e, 3, truth, 2))] == [2, 0, 3]
    assert len({a for a, _ in take(seeds.blocked_random(blocks, 3, truth, 2))}) == 3


def test_pair_invariants(spark):
    p = generate.er_pair(spark, 150, 0.2, 0.8)
    truth = {r.a: r.b for r in p.truth.collect()}
    assert sorted(truth) == sorted(truth.values()) == list(range(150))
    a, b = {tuple(r) for r in p.a.collect()}, {tuple(r) for r in p.b.collect()}
    assert all(x != y and (y, x) in a for x, y in a)
    back = {v: k for k, v in truth.items()}
    b = {(back[x], back[y]) for x, y in b}
    assert len(a & b) / len(a) == pytest.approx(0.2 + 0.8 * 0.8, abs=0.05)


def test_matrix_twins(spark):
    p = generate.sbm_pair(spark, 40, 3, 0.5)
    m = np.zeros((120, 120), np.int8)
    for x, y in p.a.collect():
        m[x, y] = 1
    for column, df, twin in (
        ("degree", scores.degree(p.vertices, p.a), graphs.degree),
        ("neighbor_degree", scores.neighbor_degree(p.vertices, p.a), graphs.neighbor_degree),
        ("triangles", scores.triangles(p.vertices, p.a), graphs.triangles),
        ("ratio", scores.triangle_degree_ratio(p.vertices, p.a), graphs.triangle_ratio),
        ("jaccard", scores.jaccard_neighborhood(p.vertices, p.a), graphs.mean_jaccard),
    ):
        assert values(df, column) == pytest.approx(twin(m).tolist(), abs=1e-8), column
    between = np.array(values(scores.betweenness(p.vertices, p.a), "betweenness")) * 119 * 118
    assert between == pytest.approx(graphs.betweenness(m), abs=1e-3)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10_000))
def test_assignment_is_best(n, seed):
    from itertools import permutations

    gain = np.random.default_rng(seed).integers(0, 9, (n, n)).astype(float)
    found = lap.assign(gain)
    assert sorted(found) == list(range(n))
    assert gain[np.arange(n), found].sum() == max(sum(gain[i, p[i]] for i in range(n)) for p in permutations(range(n)))


def test_percolation_by_hand():
    full = 1 - np.eye(4, dtype=int)
    seeds_ = np.array([(0, 0), (1, 1)])
    assert matching.percolate(full, full, seeds_).tolist() == [0, 1, 2, 3]
    assert matching.percolate(full, full, np.empty((0, 2), int)).tolist() == [-1] * 4


def test_matching_recovers():
    rng = np.random.default_rng(5)
    a, b, truth = graphs.er(rng, 100, 0.3, 0.9)
    chosen = rng.permutation(100)[:12]
    s = np.stack([chosen, truth[chosen]], 1)
    found, history = matching.seeded_match(a, b, s)
    assert sorted(found) == list(range(100)) and (found[chosen] == truth[chosen]).all()
    assert (found == truth).mean() > 0.95
    assert all(y >= x - 1e-6 for x, y in zip(history.objectives, history.objectives[1:]))
    grown = matching.percolate(a, b, s)
    got = grown[grown >= 0]
    assert len(set(got)) == len(got) and (grown == truth).mean() > 0.8
    everything = np.stack([np.arange(100), truth], 1)
    assert (matching.seeded_match(a, b, everything)[0] == truth).all()


def test_batched_percolation(spark):
    p = generate.er_pair(spark, 120, 0.3, 0.95)
    s = seeds.highest_degree(p.vertices, p.a, 15, p.truth)
    found = percolation.percolate(p.vertices, p.a, p.b, s)
    assert percolation.match_ratio(p.truth, found).first()[0] > 0.9
    pairs = [r.b for r in found.collect() if r.b is not None]
    assert len(pairs) == len(set(pairs))
    assert percolation.match_ratio_unseeded(p.truth, found, s).first()[0] <= 1


def batched(a, b, pairs, expand=True, r=2):
    """percolation.percolate by brute force: matrices and loops."""
    out, marks, before = dict(pairs), np.zeros((len(a), len(b)), int), None
    sources = list(pairs)
    while True:
        for i, j in sources:
            marks[np.ix_(a[i] > 0, b[j] > 0)] += 1
        open_ = [(i, j) for i, j in np.argwhere(marks).tolist() if i not in out and j not in out.values()]
        key = {(i, j): (-marks[i, j], abs(a[i].sum() - b[j].sum()), i, j) for i, j in open_ if marks[i, j] >= r}
        best_i = {i: min(v for k, v in key.items() if k[0] == i) for i, _ in key}
        best_j = {j: min(v for k, v in key.items() if k[1] == j) for _, j in key}
        sources = [k for k, v in key.items() if v == best_i[k[0]] == best_j[k[1]]]
        if not sources:
            sources = [k for k in open_ if marks[k] < r]
            if not expand or not sources or sources == before:
                return out
            before = sources
        else:
            out |= dict(sources)


def test_batched_percolation_expands_when_stuck(spark):
    rng = np.random.default_rng(3)
    a, b, truth = graphs.er(rng, 60, 0.08, 0.9)
    chosen = np.argsort(-a.sum(1), kind="stable")[:3]
    pairs = [(int(i), int(truth[i])) for i in chosen]
    want, stuck = batched(a, b, pairs), batched(a, b, pairs, expand=False)
    assert len(want) > len(stuck)
    edges = lambda m: spark.createDataFrame(np.argwhere(m).tolist(), "src bigint, dst bigint")
    found = percolation.percolate(spark.range(60), edges(a), edges(b), spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert {x.a: x.b for x in found.collect() if x.b is not None} == want


def test_batched_percolation_by_components(spark, monkeypatch):
    """Three separate pairs, two with seeds: components give what brute force gives, and too large ones go to the joins."""
    rng = np.random.default_rng(8)
    n, a, b, pairs = 40, np.zeros((120, 120), int), np.zeros((120, 120), int), []
    for k in range(3):
        x, y, truth = graphs.er(rng, n, 0.12, 0.9)
        own = slice(k * n, (k + 1) * n)
        a[own, own], b[own, own] = x, y
        if k < 2:
            pairs += [(int(i) + k * n, int(truth[i]) + k * n) for i in np.argsort(-x.sum(1), kind="stable")[:3]]
    edges = lambda m: spark.createDataFrame(np.argwhere(m).tolist(), "src bigint, dst bigint")
    tables = spark.range(120), edges(a), edges(b), spark.createDataFrame(pairs, "a bigint, b bigint")
    want = batched(a, b, pairs)
    assert len(want) > len(pairs) + 10
    found = percolation.percolate_by_components(*tables, 2, True)
    assert {x.a: x.b for x in found.collect()} | dict(pairs) == want
    three = percolation.percolate_by_components(*tables, 3, True, parts=2)
    assert {x.a: x.b for x in three.collect()} | dict(pairs) == batched(a, b, pairs, r=3)
    monkeypatch.setattr(percolation, "CELLS", n * n - 1)
    assert percolation.percolate_by_components(*tables, 2, True) is None
    monkeypatch.setattr(percolation, "percolate_by_joins", lambda *args: tables[3])
    assert {x.a: x.b for x in percolation.percolate(*tables).collect() if x.b is not None} == dict(pairs)


def test_percolation_by_cells(spark, monkeypatch):
    """Graphs too large for matrices give what matrices give, with odd edges, counts beyond a byte and strange vertices too."""
    rng = np.random.default_rng(5)
    for k in range(60):
        n, m, r = (int(x) for x in rng.integers([2, 2, 1], [50, 50, 4]))
        a, b = ((rng.random((x, x)) < rng.choice([0.05, 0.1, 0.3])).astype(int) for x in (n, m))
        if k % 2:
            a, b = a | a.T, b | b.T
        if k % 5 == 0:
            a = a * rng.integers(1, 4, a.shape) * (40 if k % 3 == 0 else 1)
        s = int(rng.integers(1, 4))
        pairs = np.stack([rng.choice(x, min(s, n, m), replace=False) for x in (n, m)])
        known = (rng.random(n) < 0.9, rng.random(m) < 0.9) if k % 3 == 0 else None
        lists = [np.repeat(np.argwhere(x), x[x > 0], axis=0).T for x in (a, b)]
        want = matching.percolate_batched(a, b, pairs, r, k % 4 > 0, known)
        assert matching.percolate_by_cells(n, m, *lists, pairs, r, k % 4 > 0, known).tolist() == want.tolist()
    a, b, truth = graphs.er(rng, 60, 0.08, 0.9)
    pairs = [(int(i), int(truth[i])) for i in np.argsort(-a.sum(1), kind="stable")[:3]]
    edges = lambda m: spark.createDataFrame(np.argwhere(m).tolist(), "src bigint, dst bigint")
    monkeypatch.setattr(percolation, "MATRIX", 0)
    monkeypatch.setattr(percolation, "percolate_by_joins", None)
    found = percolation.percolate(spark.range(60), edges(a), edges(b), spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert {x.a: x.b for x in found.collect() if x.b is not None} == batched(a, b, pairs)


def test_isolated_and_disconnected(spark):
    v, none = spark.range(4), spark.createDataFrame([], "src bigint, dst bigint")
    for df in (scores.degree(v, none), scores.triangles(v, none), scores.jaccard_neighborhood(v, none), scores.betweenness(v, none), scores.neighbor_degree(v, none)):
        assert [r[1] for r in df.collect()] == [0] * 4
    lone = graphs.embedding(np.zeros((5, 5)))
    assert np.isfinite(lone).all()


def test_betweenness_seeds_of_the_whole_pair(spark, monkeypatch):
    from itertools import combinations

    from pairloom.plans import queries

    p = generate.er_pair(spark, 30, 0.12, 0.8)
    monkeypatch.setattr(queries, "pair", lambda spark, sf_dir: p)
    got = {r.a: (r.b, r.seed_rank) for r in queries.QUERIES["seeds_betweenness_coorder"](spark, "").collect()}
    near = {v: set() for v in range(30)}
    for e in p.a.collect():
        near[e.src].add(e.dst)

    def shortest(s, t):
        paths, seen = [[s]], {s}
        while paths:
            if done := [q for q in paths if q[-1] == t]:
                return done
            paths = [[*q, v] for q in paths for v in near[q[-1]] if v not in seen]
            seen |= {q[-1] for q in paths}
        return []

    score = dict.fromkeys(range(30), 0.0)
    for s, t in combinations(range(30), 2):
        found = shortest(s, t)
        for q in found:
            for v in q[1:-1]:
                score[v] += 2 / len(found) / (29 * 28)
    truth = {r.a: r.b for r in p.truth.collect()}
    order = sorted(score, key=lambda v: (-round(score[v], scores.DIGITS), v))[: queries.K]
    assert got == {v: (truth[v], k) for k, v in enumerate(order, 1)}


def test_spectral_queries_have_the_references_size(spark):
    from pairloom.plans import queries

    assert queries.QUERIES["spectral_embedding"](spark, "").where("graph = 0").count() == 600


def test_paths_of_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(66)]
    edges = spark.createDataFrame(chain, "src bigint, dst bigint").coalesce(1).checkpoint()
    got = scores.bfs_levels(spark.range(0, 1, 1, 1), edges).select("v", "dist", "sigma").collect()
    assert sorted(map(tuple, got)) == [(k, k, 1) for k in range(67)]


def test_paths_stay_in_their_component(monkeypatch):
    """Copies of a graph side by side: each vertex's sum is the lone copy's, and no table of edges times sources is made."""
    from pairloom.kernels import bfs

    rng = np.random.default_rng(8)
    m = np.triu(rng.random((40, 40)) < 0.1, 1)
    m[0, 1:] = True  # a hub
    one = np.argwhere(m)
    monkeypatch.setattr(bfs, "TOGETHER", 16)
    monkeypatch.setattr(bfs, "HUB", 30)
    whole = one + 100 * np.arange(5)[:, None, None]
    src, dst = whole[..., 0].ravel(), whole[..., 1].ravel()
    ids = np.r_[(np.arange(40) + 100 * np.arange(5)[:, None]).ravel(), 7000, 7001, 50]
    g = bfs.Graph(rng.permutation(ids), src, dst, half=True)
    assert len(g.cuts) - 1 >= 5
    found = dict(zip(g.ids.tolist(), g.dependencies(np.sort(ids)).tolist(), strict=True))
    want = graphs.betweenness((m | m.T).astype(np.int8))
    for copy in range(5):
        assert [found[100 * copy + v] for v in range(40)] == pytest.approx(want.tolist())
    assert found[50] == found[7000] == found[7001] == 0


def test_large_components_are_searched_by_levels(monkeypatch):
    """Odd graphs as by whole steps; and a search meets an edge a few times, however many levels there are."""
    from pairloom.kernels import bfs

    rng = np.random.default_rng(21)
    for k in range(30):
        n = int(rng.integers(2, 60))
        s, d = (np.arange(n - 1), np.arange(1, n)) if k % 3 == 0 else rng.integers(0, n, (2, int(rng.integers(0, 200))))
        if k % 3 == 1:  # a hub, with itself too
            s, d = np.r_[s, np.zeros(n, int)], np.r_[d, np.arange(n)]
        g = bfs.Graph(np.arange(n) * 7, s * 7, d * 7, half=True)
        monkeypatch.setattr(bfs, "LARGE", 10**9)
        want = g.dependencies(np.arange(n) * 7)
        monkeypatch.setattr(bfs, "LARGE", 0)
        assert g.dependencies(np.arange(n) * 7) == pytest.approx(want)
    met, near = [], bfs.Search.near
    monkeypatch.setattr(bfs.Search, "near", lambda self, *args: met.append(len((out := near(self, *args))[0])) or out)
    g = bfs.Graph(np.arange(400), np.arange(399), np.arange(1, 400), half=True)
    g.dependencies(np.array([0]))
    assert 0 < sum(met) <= 2 * len(g.src)


def test_betweenness_seeds_of_a_large_component(spark, monkeypatch):
    """The seeds of brute force on a graph of over LARGE edges, of which each search meets few, as on the co-order pair."""
    from pairloom.kernels import bfs

    p = generate.er_pair(spark)
    e = np.array(p.a.select("src", "dst").collect()).T
    m = np.zeros((600, 600), np.int8)
    m[tuple(e)] = 1
    assert e.shape[1] > bfs.LARGE
    best = np.lexsort((np.arange(600), -np.round(graphs.betweenness(m) / 599 / 598, 9)))[:5]
    got = {r.seed_rank: r.a for r in seeds.betweenness(p.vertices, p.a, 5, p.truth).collect()}
    assert [got[k + 1] for k in range(5)] == best.tolist()
    met, near = [], bfs.Search.near
    monkeypatch.setattr(bfs.Search, "near", lambda self, *args: met.append(len((out := near(self, *args))[0])) or out)
    bfs.Graph(np.arange(600), *e).dependencies(np.arange(20))
    assert 0 < sum(met) <= 20 * e.shape[1]


def test_betweenness_holds_little(spark):
    """A task's memory for 30,000 vertices and 1,200,000 edges, in the kernel that it runs."""
    import tracemalloc

    from pairloom.kernels import bfs

    rng = np.random.default_rng(9)
    e = rng.integers(0, 30_000, (2, 600_000))
    e = np.unique(np.sort(e[:, e[0] != e[1]], axis=0), axis=1)
    tracemalloc.start()
    g = bfs.Graph(np.arange(30_000), *np.concatenate([e, e[::-1]], axis=1))
    g.dependencies(np.arange(32))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


def plain_distance(points):
    """scores.pairwise_distance by a join and array functions."""
    from pyspark.sql import functions as F

    a, b = points.select(F.col("id").alias("i"), F.col("v").alias("x")), points.select(F.col("id").alias("j"), F.col("v").alias("y"))
    square = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", F.round(F.sqrt(square), 6).alias("distance"))


def test_distances_meet_by_blocks(spark):
    """All pairs as by a join of arrays, odd rows too, without a join of all rows."""
    rng = np.random.default_rng(11)
    rows = [(k, rng.normal(size=12).astype(np.float32).astype(float).tolist()) for k in range(150)]
    rows += [(150, None), (151, [1.0, None]), (152, [1.0, 2.0]), (153, [1.0, float("nan")]), (154, []), (155, []), (156, [float("inf")] * 12), (157, [0.0000005, 0.0]), (158, [0.0, 0.0]), (159, [3e30, 0.0]), (None, [1.0, 2.0]), (7, [0.5, 2.0])]
    points = spark.createDataFrame(rows, "id bigint, v array<double>")
    df = scores.pairwise_distance(points, block_rows=40)
    assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
    key = lambda df: sorted((r.i, r.j, repr(r.distance)) for r in df.collect())
    assert key(df) == key(plain_distance(points))


def test_distances_send_a_point_to_few_tasks(spark, monkeypatch):
    """However many points there are, each is sent to as many tasks as there are blocks; pieces of blocks lose no pair."""
    rng = np.random.default_rng(13)
    rows = [(k, (rng.normal(size=2 + k % 3) if k % 7 == 0 else rng.normal(size=3).astype(np.float32)).astype(float).tolist()) for k in [*range(300), 5, 5]]
    points = spark.createDataFrame(rows, "id bigint, v array<double>")
    monkeypatch.setattr(scores, "PIECE", 16)
    df = scores.pairwise_distance(points, block_rows=10)
    assert df.rdd.getNumPartitions() == scores.BLOCKS * (scores.BLOCKS + 1) // 2
    key = lambda df: sorted((r.i, r.j, repr(r.distance)) for r in df.collect())
    assert key(df) == key(plain_distance(points))
    assert key(scores.pairwise_distance(points, most_bytes=1024)) == key(plain_distance(points))


def test_rounded_as_spark_rounds(spark):
    from pyspark.sql import functions as F

    x = [0.0, 5e-7, 1.5e-6, 2.5e-6, 1.0000005, 1.0000015, 123.4567895, 4503599627.3704965, 1e300, float("inf")] + np.random.default_rng(12).random(500).tolist()
    want = [r.y for r in spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double").withColumn("y", F.round("x", 6)).orderBy("k").collect()]
    assert scores.rounded(np.array(x), 6).tolist() == want
