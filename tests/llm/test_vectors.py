import math

import numpy as np
import pytest

from pairloom.llm import neighbours
from pyspark.sql import functions as F

ROWS = "vec_id bigint, embedding array<float>, label int, score double"


def brute(vectors, q, k):
    a = np.array(vectors[q], float)
    sims = [(-float(a @ np.array(v, float) / (np.linalg.norm(a) * np.linalg.norm(np.array(v, float)))), i) for i, v in vectors.items() if i != q]
    return sorted(sims)[:k]


def test_recall_on_a_built_graph(spark, monkeypatch):
    """Several leaves, so that descent and search do the work; clusters, a dense one, and copies."""
    monkeypatch.setattr(neighbours, "LEAF", 150)
    monkeypatch.setattr(neighbours, "LEAF_MOST", 240)
    monkeypatch.setattr(neighbours, "K", 24)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 24))
    x = np.concatenate([centres[rng.integers(8, size=1200)] + rng.normal(size=(1200, 24)), centres[0] + 0.05 * rng.normal(size=(300, 24))]).astype(np.float32)
    x[700:720] = x[700]
    df = spark.createDataFrame([(k, v.tolist(), 0, 0.0) for k, v in enumerate(x)], ROWS)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 20):
        own = sorted(found[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert [s for _, _, s in own] == sorted((s for _, _, s in own), reverse=True)
        s = unit @ unit[q]
        s[q] = -9
        fifth = np.sort(s)[-5]
        for _, i, score in own:
            assert score == pytest.approx(s[i], abs=1e-12)
            hits += s[i] >= fifth - 1e-12
    assert hits / (75 * 5) >= 0.9
    assert [i for _, i, _ in sorted(found[700])] == [701, 702, 703, 704, 705]  # copies by id


def test_odd_vectors(spark):
    vectors = {0: [1.0, 0.0], 50: [0.0, 2.0], 1: [1.0, 1.0], 2: [2.0, 0.0], 3: [-1.0, 0.0]}
    rows = [(i, v, None, None) for i, v in vectors.items()] + [(4, None, 1, 1.0), (100, [0.0, 0.0], 1, 1.0), (5, [math.nan, 1.0], 1, 1.0), (6, [math.inf, 1.0], 1, 1.0), (7, [None, 1.0], 1, 1.0), (8, [], 1, 1.0), (9, [1.0, 2.0, 3.0], 1, 1.0), (0, [1.0, 0.0], 2, 2.0), (None, [1.0, 0.5], 0, 0.0)]
    got = neighbours.nearest(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 50 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == {0, 50}
    for q, own in by.items():
        want = brute(vectors, q, 5)
        assert [i for i, _ in own] == [i for _, i in want]
        assert [s for _, s in own] == pytest.approx([-s for s, _ in want])
    empty = spark.createDataFrame([], ROWS)
    assert neighbours.nearest(empty, F.col("vec_id") % 50 == 0).count() == 0
    lone = spark.createDataFrame(rows[:1], ROWS)
    assert neighbours.nearest(lone, F.col("vec_id") % 50 == 0).count() == 0


def test_blocks_fetch_in_proportion(spark):
    """As many blocks for five times the nodes, none of far more than its share, whatever the leaves."""
    blocks = {}
    for n in (10_256, 51_282):
        depth = math.ceil(math.log2(n / neighbours.LEAF))
        rows = spark.range(n).selectExpr("id as node", "cast(null as binary) as x", f"if(id % 4 = 0, 0, id % {1 << depth}) as leaf")
        got = [r["count"] for r in neighbours.blocked(rows, n, depth).groupBy("block").count().collect()]
        assert sum(got) == n and max(got) <= 3 * n / neighbours.BLOCKS
        blocks[n] = len(got)
    assert blocks[10_256] == blocks[51_282] <= 2 * neighbours.BLOCKS
    big = 40 * neighbours.BLOCK_MOST
    rows = spark.range(big).selectExpr("id as node", "cast(null as binary) as x", "id % 1024 as leaf")
    assert max(r["count"] for r in neighbours.blocked(rows, big, 10).groupBy("block").count().collect()) <= 2 * neighbours.BLOCK_MOST
