"""Vertex scores over an edge table. Vertices without edges keep their rows."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.kernels import bfs
from pairloom.session import checkpoints

WIDE = Context(prec=400)
BLOCKS = 5  # of points, each pair of which meets in one of 15 tasks
PIECE = 1024  # points that meet at once
DIGITS = 9  # sums of fractions are rounded, as their order varies


def degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree."""
    n = edges.groupBy(F.col("src").alias("id")).agg(F.count("dst").alias("degree"))
    return vertices.join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def neighbor_degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, neighbor_degree: the sum of the neighbours' degrees."""
    n = edges.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("d"))
    total = edges.join(n, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("d").alias("neighbor_degree"))
    return vertices.join(total, "id", "left").select("id", F.coalesce("neighbor_degree", F.lit(0)).cast("bigint").alias("neighbor_degree"))


def forward(edges: DataFrame) -> DataFrame:
    """low, high: each undirected edge once, from the end of fewer edges, so that no vertex sends many."""
    n = edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("d"))
    both = edges.where("src < dst").join(n.withColumnRenamed("v", "src").withColumnRenamed("d", "ds"), "src").join(n.withColumnRenamed("v", "dst").withColumnRenamed("d", "dd"), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    return both.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("low"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("high"))


def corners(edges: DataFrame) -> DataFrame:
    """low, x, y (x < y): each triangle once, met at its corner of fewest edges."""
    f = forward(edges)
    out = f.groupBy("low").agg(F.sort_array(F.collect_list("high")).alias("near"))
    wedge = out.select("low", F.explode(F.transform("near", lambda x, i: F.struct(x.alias("x"), F.slice("near", i + 2, F.size("near")).alias("ys")))).alias("s")).select("low", F.col("s.x").alias("x"), F.explode("s.ys").alias("y"))
    pairs = f.select(F.least("low", "high").alias("x"), F.greatest("low", "high").alias("y"))
    return wedge.join(pairs, ["x", "y"]).select("low", "x", "y")


def triangles(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, triangles: pairs of neighbours that are joined."""
    n = corners(edges).select(F.explode(F.array("low", "x", "y")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    return vertices.join(n, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).cast("bigint").alias("triangles"))


def triangle_degree_ratio(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, ratio: degree / (triangles + 1)."""
    both = degree(vertices, edges).join(triangles(vertices, edges), "id")
    return both.select("id", (F.col("degree") / (F.col("triangles") + 1)).alias("ratio"))


def jaccard_neighborhood(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, jaccard: the mean over neighbours of the share of common neighbours; 0 without neighbours.

    An edge's ends have as many common neighbours as there are triangles on the edge, so that no hub's neighbours are paired.
    """
    n = edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("d"))
    ways = edges.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    side = lambda p, q: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"))
    sides = corners(edges).select(F.explode(F.array(side("low", "x"), side("low", "y"), side("x", "y"))).alias("e")).select("e.*")
    common = sides.groupBy("u", "v").agg(F.count(F.lit(1)).alias("c"))
    each = ways.join(common, ["u", "v"], "left").join(n.select(F.col("v").alias("u"), F.col("d").alias("du")), "u").join(n.select("v", F.col("d").alias("dv")), "v")
    c = F.coalesce("c", F.lit(0))
    share = each.select("u", "v", (c / (F.col("du") + F.col("dv") - c)).alias("share"))
    both = share.select(F.col("u").alias("id"), "share").unionByName(share.select(F.col("v").alias("id"), "share"))
    mean = both.groupBy("id").agg(F.round(F.avg("share"), DIGITS).alias("jaccard"))
    return vertices.join(mean, "id", "left").select("id", F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"))


def adjacency_list(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, neighbors: sorted."""
    near = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbors"))
    return vertices.join(near, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def bfs_levels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """s, v, dist, sigma: distance from s to v, and how many shortest paths there are. A level is a join and an anti join."""
    level = vertices.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).cast("bigint").alias("dist"), F.lit(1).cast("bigint").alias("sigma"))
    seen = level
    for d in count(1):  # each level reaches new pairs, or is the last
        step = level.join(edges, level["v"] == edges["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
        level = step.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(d).cast("bigint").alias("dist"), "sigma").checkpoint()
        if not level.limit(1).count():
            break
        seen = seen.unionByName(level)
    return seen


def pairs_packed(rows: DataFrame, edges: bool) -> DataFrame:
    """edges (that flag), n, longs: the rows' two long columns, some 65,536 rows in a row."""

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, n = [], 0

        def row():
            flat = np.concatenate(held, axis=1)
            return pa.RecordBatch.from_arrays([pa.array([edges]), pa.array([flat.shape[1]], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["edges", "n", "longs"])

        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            n += batch.num_rows
            if n >= 65_536:
                yield row()
                held, n = [], 0
        if n:
            yield row()

    return rows.mapInArrow(pack, "edges boolean, n long, longs binary")


def betweenness(vertices: DataFrame, edges: DataFrame, parts: int = 16, most: int = 20_000_000) -> DataFrame:
    """id, betweenness: the share of shortest paths through it, as a fraction of the other pairs.

    Sources are dealt into parts; a part's task gets its sources, all vertices and all edges (at most most of
    each, checked; packed, each edge once) and adds up its sources' dependencies, component by component. The
    sums meet by vertex; nothing goes to the driver.
    """
    checkpoints(vertices.sparkSession)
    own = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("long")
    sent = pairs_packed(vertices.select("id", own), False).unionByName(pairs_packed(edges.where("src < dst").select("src", "dst"), True)).checkpoint()
    n, m = sent.agg(F.coalesce(F.sum(F.when(~F.col("edges"), F.col("n"))), F.lit(0)), 2 * F.coalesce(F.sum(F.when(F.col("edges"), F.col("n"))), F.lit(0))).first()
    if max(n, m) > most:
        raise ValueError(f"{n} vertices and {m} edges; a task holds at most {most} of each")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, part = ([], []), None
        for batch in batches:
            for p, is_edge, longs in zip(batch["part"].to_pylist(), batch["edges"].to_pylist(), batch["longs"].to_pylist(), strict=True):
                part = p
                held[is_edge].append(np.frombuffer(longs, np.int64).reshape(2, -1))
        if held[0]:
            (ids, own), (src, dst) = (np.concatenate(x, axis=1) if x else np.empty((2, 0), np.int64) for x in held)
            del held
            g = bfs.Graph(ids, src, dst, half=True)
            sources = np.sort(ids[own == part])
            del ids, own, src, dst
            total = g.dependencies(sources)
            some = total != 0
            yield pa.RecordBatch.from_arrays([pa.array(g.ids[some]), pa.array(total[some])], names=["id", "delta"])

    dealt = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartitionById(parts, F.col("part"))
    sums = dealt.mapInArrow(run, "id bigint, delta double").groupBy("id").agg(F.sum("delta").alias("d"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return vertices.join(sums, "id", "left").select("id", F.round(F.coalesce("d", F.lit(0.0)) * scale, DIGITS).alias("betweenness"))


def nn_distance(points: DataFrame, block_rows: int = 1024) -> DataFrame:
    """id, distance: to the nearest other point. points: id, v (array).

    Points are dealt into blocks; each pair of blocks meets in one task, which holds the two, and a row a
    point leaves it. The work is that of all pairs, which the operator asks for.
    """
    n = points.count()
    blocks = max(1, -(-n // block_rows))
    own = points.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = other.select("id", "v", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") <= F.col("other")).alias("first"))

    def least(t):
        import pandas as pd

        if t["x"].iloc[0] == t["y"].iloc[0]:
            a = b = t
        else:
            a, b = t[t["first"]], t[~t["first"]]
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "d": []})
        x, y, i, j = np.stack(a["v"]).astype(float), np.stack(b["v"]).astype(float), a["id"].to_numpy(), b["id"].to_numpy()
        of_a, of_b = np.full(len(x), np.inf), np.full(len(y), np.inf)
        for k in range(0, len(x), 64):
            d = ((x[k : k + 64, None, :] - y[None]) ** 2).sum(2)
            d[i[k : k + 64, None] == j[None]] = np.inf
            of_a[k : k + 64] = d.min(1)
            of_b = np.minimum(of_b, d.min(0))
        return pd.DataFrame({"id": np.r_[i, j], "d": np.sqrt(np.r_[of_a, of_b])})

    each = dealt.groupBy("x", "y").applyInPandas(least, "id bigint, d double")
    return each.groupBy("id").agg(F.round(F.min("d"), 6).alias("distance"))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds: the shortest decimal of x, halves away from zero. x: not negative."""
    with np.errstate(over="ignore"):
        y = np.where(np.isfinite(x), x, 0) * 10.0**digits
    out = np.rint(y) / 10.0**digits
    near = np.flatnonzero((np.abs(y - np.floor(y) - 0.5) <= 1e-6 + 4e-16 * y) | ~(y <= 2.0**52))
    for k in near[np.isfinite(x[near])].tolist():  # few are near a half
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, WIDE))
    return np.where(np.isfinite(x), out, x)


def points_packed(points: DataFrame) -> DataFrame:
    """block, ids, dims, wide, flat of points (id, dims, v, block): many rows of a block in one, as floats where these say the same."""

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, dims, block = (batch[c].to_numpy() for c in ("id", "dims", "block"))
            flat, of = batch["v"].flatten().to_numpy(zero_copy_only=False), np.repeat(block, np.maximum(dims, 0))
            for k in np.unique(block).tolist():
                x = flat[of == k]
                with np.errstate(over="ignore"):
                    narrow = x.astype(np.float32)
                wide = not np.array_equal(narrow.astype(float), x, equal_nan=True)
                own = block == k
                yield pa.RecordBatch.from_pydict({"block": [k], "ids": [ids[own].tobytes()], "dims": [dims[own].tobytes()], "wide": [wide], "flat": [(x if wide else narrow).tobytes()]})

    return points.mapInArrow(pack, "block long, ids binary, dims binary, wide boolean, flat binary")


def pairwise_distance(points: DataFrame, block_rows: int = 1024, most_bytes: int = 160 << 20) -> DataFrame:
    """i, j, distance for all i < j: a row a pair, null where a vector is null or holds null or the lengths differ.

    Each pair of blocks of points meets in one task, piece by piece, and a point is sent to a task for each block.
    So there are as few blocks as BLOCKS tasks' work and most_bytes of a block allow. A task's sums go over the
    dimensions in turn, as SQL's do.
    """
    points = points.where(F.col("id").isNotNull())
    whole = F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False))
    sized = points.select(F.col("id").cast("long"), F.when(whole, F.size("v")).otherwise(-1).alias("dims"), F.when(whole, F.col("v")).alias("v"))
    n, size = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest("dims", F.lit(0)) * F.lit(8).cast("long") + 12), F.lit(0))).first()
    blocks = max(1, min(BLOCKS, -(-n // block_rows)), -(-size // most_bytes))
    own = points_packed(sized.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    x, y = F.least("block", "other"), F.greatest("block", "other")
    part = (x * blocks + y - F.floor(x * (x + 1) / 2)).cast("int")
    dealt = other.select(part.alias("part"), (F.col("block") == F.col("other")).alias("alone"), (F.col("block") < F.col("other")).alias("first"), "ids", "dims", "wide", "flat")

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, alone = ([], []), True
        for batch in batches:
            for row in batch.to_pylist():
                alone = row["alone"]
                ids, dims = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["dims"], np.int32)
                flat, first = np.frombuffer(row["flat"], float if row["wide"] else np.float32), np.r_[0, np.cumsum(np.maximum(dims, 0))]
                for k in range(0, len(ids), PIECE):
                    held[row["first"]].append((ids[k : k + PIECE], dims[k : k + PIECE], flat[first[k] : first[min(k + PIECE, len(ids))]]))
        one, two = pieces(held[0]), pieces(held[0] if alone else held[1])
        del held
        for p, (ids, dims, flat) in enumerate(one):
            columns = np.ascontiguousarray(dense(dims, flat).T)
            for q, (ids2, dims2, flat2) in enumerate(two):
                if alone and q < p:
                    continue
                rows = dense(dims2, flat2)
                if rows.shape[1] != len(columns):  # of other lengths
                    width = max(rows.shape[1], len(columns))
                    rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
                    across = np.pad(columns, ((0, width - len(columns)), (0, 0)))
                else:
                    across = columns
                for k in range(0, len(rows), 64):
                    some = rows[k : k + 64]
                    total = np.zeros((len(some), len(ids)))
                    with np.errstate(invalid="ignore", over="ignore"):
                        for d, column in enumerate(across):
                            off = some[:, d, None] - column
                            total += off * off
                    known = (dims2[k : k + 64, None] == dims) & (dims >= 0)
                    i, j = np.broadcast_to(ids2[k : k + 64, None], total.shape), np.broadcast_to(ids, total.shape)
                    ok = i < j if alone and p == q else i != j
                    i, j, distance = i[ok], j[ok], rounded(np.sqrt(total[ok]), 6)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(distance, mask=~known[ok])], names=["i", "j", "distance"])

    return dealt.repartitionById(blocks * (blocks + 1) // 2, F.col("part")).mapInArrow(meet, "i bigint, j bigint, distance double")


def pieces(found: list) -> list:
    """Packed points (ids, dims, flat), joined to some PIECE points each."""
    out, held, n = [], [], 0
    for x in found:
        held.append(x)
        n += len(x[0])
        if n >= PIECE:
            out.append(tuple(map(np.concatenate, zip(*held, strict=True))))
            held, n = [], 0
    return [*out, tuple(map(np.concatenate, zip(*held, strict=True)))] if held else out


def dense(dims: np.ndarray, flat: np.ndarray) -> np.ndarray:
    x = np.zeros((len(dims), max(0, int(dims.max(initial=0)))))
    x[np.arange(x.shape[1]) < dims[:, None]] = flat
    return x
