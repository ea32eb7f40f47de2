"""Approximate nearest neighbours by cosine: NN-descent builds a graph, queries search it greedily.

1. Vectors that differ by a power of two are one node (a 64-bit hash of the vector, scaled), so that copies
   do not crowd a list.
2. The first lists come from TREES random-projection trees, fitted on a bounded sample of the vectors
   (SAMPLE rows): nodes of a leaf are compared with each other; a leaf of over LEAF_MOST nodes is dealt
   into parts by hash. Every vector is in each tree.
3. NN-descent, ROUNDS times: a node's list and the nodes that list it (K each) are compared with each
   other, and each takes the best of those it meets (neighbours of neighbours). Nodes meet by blocks
   (neighbouring leaves of the first tree): a block fetches each vector it needs once.
4. A query's beam starts at its own list; HOPS times, the best EXPAND nodes not yet expanded bring in
   their lists, and the best BEAM stay. All of the beam that float32 can't tell from the k nearest are then
   scored in double precision, and ties go to the smaller vec_id.

These steps are the same for tables of any size. Lists are bounded by K, beams by BEAM, so no step holds
more than a block. Recall is measured in tests/llm against brute force.

Vectors that are null, empty or zero, or hold null or non-finite parts, take no part. Rows that repeat
vec_id and vector count once. A vec_id with several vectors is a candidate with each (and a query with
each; its results are the best over them, none being its own id). Fewer than k candidates: all of them.
Empty table: no rows. Vectors of unequal lengths: only those of the commonest length take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table

K = 48
TREES, LEAF, LEAF_MOST, SAMPLE = 4, 200, 400, 4096
ROUNDS, MEET = 2, 16
BEAM, EXPAND, HOPS = 256, 32, 6
BLOCKS, BLOCK_MOST = 16, 4096  # blocks, and more only where one would hold more nodes than that: the fewer, the fewer fetch a vector
QUERIES = 512  # in a block
LISTS = "node long, ids array<long>, sims array<float>"


def as_matrix(column) -> np.ndarray:
    """Rows of float32 bytes."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1) if raw else np.zeros((0, 1), np.float32)


def lists_of(ids: np.ndarray, starts: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))


def best_lists(node: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat (node, other, sim) to each node's k best distinct others: nodes, starts, others, sims."""
    ok = (other != node) & np.isfinite(sim)
    node, other, sim = node[ok], other[ok], sim[ok]
    order = np.lexsort((other, node))
    node, other, sim = node[order], other[order], sim[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
    node, other, sim = node[new], other[new], sim[new]
    order = np.lexsort((-sim, node))
    node, other, sim = node[order], other[order], sim[order]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.empty(0, int)
    rank = np.arange(len(node)) - np.repeat(first, np.diff(np.r_[first, len(node)]))
    keep = rank < k
    node, other, sim = node[keep], other[keep], sim[keep]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.empty(0, int)
    return node[first], np.r_[first, len(node)], other, sim


def flat(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, sims = batch.column("ids"), batch.column("sims")
    if hasattr(ids, "combine_chunks"):
        ids, sims = ids.combine_chunks(), sims.combine_chunks()
    n = np.diff(ids.offsets.to_numpy())
    return np.repeat(batch.column("node").to_numpy(), n), ids.flatten().to_numpy(), sims.flatten().to_numpy()


def list_batch(nodes, starts, others, sims):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(nodes), lists_of(others, starts), lists_of(sims.astype(np.float32), starts)], names=["node", "ids", "sims"])


def merged(lists: DataFrame, k: int) -> DataFrame:
    """One list of the k best for each node."""

    def merge(batches: Iterator) -> Iterator:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = flat(batch)
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            node = now[0]
            whole = node != batch.column("node")[-1].as_py()  # the last node may go on in the next batch
            if whole.any():
                yield list_batch(*best_lists(*(x[whole] for x in now), k))
            rest = tuple(x[~whole] for x in now)
            nodes, starts, others, sims = best_lists(*rest, k)
            held = (np.repeat(nodes, np.diff(starts)), others, sims)
        if held is not None and len(held[0]):
            yield list_batch(*best_lists(*held, k))

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(merge, LISTS)


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v (doubles, scaled by a power of two so that the largest is from 0.5 to 1), node: rows whose vectors can take part, once each."""

    def scale(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("v")
            at, x = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            x = x[at[0] : at[-1]]
            of = np.repeat(np.arange(batch.num_rows), np.diff(at))
            most = np.maximum.reduceat(np.abs(x), at[:-1] - at[0]) if batch.num_rows else np.empty(0)
            x = np.ldexp(x, -np.frexp(most)[1][of]) + 0.0  # exact but for what is far too small to count
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(x))], names=["vec_id", "v"])

    v = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(sound).where(F.exists("v", lambda x: x != 0)).mapInArrow(scale, "vec_id long, v array<double>")
    return v.withColumn("node", F.xxhash64("v")).dropDuplicates(["vec_id", "node"])


def unit(rows: DataFrame) -> DataFrame:
    """node, x: the vector scaled to length 1, as float32 bytes, a row for each node."""

    def scale(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in x], pa.binary())], names=["node", "x"])

    return rows.groupBy("node").agg(F.min("v").alias("v")).mapInArrow(scale, "node long, x binary")


class Tree:
    """Median splits of a sample by differences of two of its points, then signs of random directions."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth, self.cuts = depth, {}
        self.more = rng.standard_normal((max(depth, 1), sample.shape[1] if len(sample) else 1)).astype(np.float32)
        parts = {0: np.arange(len(sample))}
        for d in range(depth):
            new = {}
            for at, own in parts.items():
                if len(own) >= 16:
                    a, b = rng.choice(own, 2, replace=False)
                    way = sample[a] - sample[b]
                    side = sample[own] @ way
                    self.cuts[d, at] = (way, float(np.median(side)))
                    right = side > self.cuts[d, at][1]
                    new[2 * at], new[2 * at + 1] = own[~right], own[right]
            parts = new

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for d in range(self.depth):
            right = np.zeros(len(x), np.int64)
            for k in np.unique(at):
                own = at == k
                way, cut = self.cuts.get((d, int(k)), (self.more[d], 0.0))
                right[own] = x[own] @ way > cut
            at = 2 * at + right
        return at


def first_lists(units: DataFrame, n: int, scratch: Scratch, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Lists from the trees, and node, x, block."""
    spark = units.sparkSession
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    share = min(1.0, SAMPLE / max(n, 1))
    some = as_matrix(units.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy("node").limit(2 * SAMPLE).toArrow()["x"])
    trees = spark.sparkContext.broadcast([Tree(some, depth, seed) for seed in range(TREES if depth else 1)])

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = as_matrix(batch.column("x"))
            for t, tree in enumerate(trees.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(tree.leaves(x)), batch.column("node"), batch.column("x")], names=["tree", "leaf", "node", "x"])

    placed = scratch.keep(units.mapInArrow(place, "tree int, leaf long, node long, x binary"), "placed")
    sizes = placed.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / LEAF_MOST).alias("parts"))
    parted = placed.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), "parts"))

    def compare(t):
        import pyarrow as pa

        node, x = t["node"].to_numpy(), as_matrix(t["x"])
        sim = x @ x.T
        np.fill_diagonal(sim, -9)
        few = min(k, len(node) - 1)
        if few < 1:
            return pa.Table.from_batches([list_batch(np.empty(0, np.int64), np.zeros(1, int), np.empty(0, np.int64), np.empty(0, np.float32))])
        best = np.argpartition(-sim, few - 1, axis=1)[:, :few]
        starts = np.arange(len(node) + 1) * few
        return pa.Table.from_batches([list_batch(node, starts, node[best].ravel(), np.take_along_axis(sim, best, 1).ravel())])

    lists = parted.groupBy("tree", "leaf", "part").applyInArrow(compare, LISTS)
    return lists, blocked(placed.where("tree = 0"), n, depth)


def blocked(placed: DataFrame, n: int, depth: int) -> DataFrame:
    """node, x, block: leaves (of depth splits) that share their first splits, dealt by hash where they hold over twice an even share.

    A block fetches up to all nodes, and as many of them as 2 * K a node of its own. So that what blocks fetch
    grows as n does, their number stays while they can hold it.
    """
    splits = min(depth, (max(BLOCKS, -(-n // BLOCK_MOST)) - 1).bit_length())
    even = -(-n // (1 << splits))
    grouped = placed.withColumn("group", F.shiftright("leaf", depth - splits))
    sizes = grouped.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / (2 * max(even, 1))).alias("parts"))
    part = F.pmod(F.xxhash64("node", F.lit(3)), "parts")
    return grouped.join(sizes, "group").select("node", "x", F.xxhash64("group", part).alias("block"))


def reversed_lists(graph: DataFrame, k: int) -> DataFrame:
    """For each node, nodes that list it, k best of each task."""

    def turn(batches: Iterator) -> Iterator:
        held = []
        for batch in batches:
            node, other, sim = flat(batch)
            held.append((other, node, sim))
            if sum(len(h[0]) for h in held) > 2_000_000:
                yield list_batch(*best_lists(*(np.concatenate(x) for x in zip(*held, strict=True)), k))
                held = []
        if held:
            yield list_batch(*best_lists(*(np.concatenate(x) for x in zip(*held, strict=True)), k))

    return graph.mapInArrow(turn, LISTS)


def descend(graph: DataFrame, blocks: DataFrame, k: int = K) -> DataFrame:
    """A round of NN-descent: what each node meets among neighbours of neighbours."""
    around = merged(graph.unionByName(merged(reversed_lists(graph, k), k)), 2 * k).join(blocks.select("node", "block"), "node").select("block", "node", "ids")
    needed = around.select("block", F.explode("ids").alias("id")).distinct()
    worst = graph.select("node", F.when(F.size("sims") < k, F.lit(-2.0).cast("float")).otherwise(F.array_min("sims")).alias("worst"))
    known = blocks.select("node", "x").join(worst, "node", "left").select(F.col("node").alias("id"), "x", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
    fetched = needed.join(known, "id").select(F.col("block").alias("at"), "id", "x", "worst")

    def meet(lists, members):
        import pyarrow as pa

        name = members["id"].to_numpy()
        order = np.argsort(name)
        name, x, worst = name[order], as_matrix(members["x"])[order], members["worst"].to_numpy()[order]
        ids = lists["ids"].combine_chunks()
        ends = ids.offsets.to_numpy()
        at = np.searchsorted(name, ids.values.to_numpy())
        rows = len(ends) - 1
        width = int(np.diff(ends).max()) if rows else 0
        found: list[tuple] = []
        pending = 0
        out = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        for a in range(0, rows, 256):
            b = min(a + 256, rows)
            n = np.diff(ends[a : b + 1])
            real = np.arange(width) < n[:, None]
            who = np.zeros((b - a, width), np.int64)
            who[real] = at[ends[a] : ends[b]]
            y = x[who]
            sim = np.matmul(y, y.transpose(0, 2, 1))
            sim[~real] = -9
            sim.transpose(0, 2, 1)[~real] = -9
            sim[:, np.arange(width), np.arange(width)] = -9
            few = min(MEET, width)
            best = np.argpartition(-sim, few - 1, axis=2)[:, :, :few]
            s = np.take_along_axis(sim, best, 2)
            ok = s > np.maximum(worst[who], -2)[:, :, None]
            u = np.broadcast_to(who[:, :, None], s.shape)[ok]
            v = np.take_along_axis(np.broadcast_to(who[:, None, :], sim.shape), best, 2)[ok]
            found.append((u, v, s[ok]))
            pending += len(u)
            if pending > 1_500_000 or b == rows:
                both = [np.concatenate([o, *f]) for o, f in zip(out, zip(*found, strict=True), strict=True)]
                nodes, starts, others, sims = best_lists(*both, k)
                out = (np.repeat(nodes, np.diff(starts)), others, sims)
                found, pending = [], 0
        nodes, starts, others, sims = best_lists(*out, k)
        return pa.Table.from_batches([list_batch(name[nodes], starts, name[others], sims)])

    return around.groupBy("block").cogroup(fetched.groupBy("at")).applyInArrow(meet, LISTS)


def build(units: DataFrame, n: int, scratch: Scratch, rounds: int = ROUNDS, k: int = K) -> tuple[DataFrame, DataFrame]:
    """The graph (node, ids, sims), and node, x, block."""
    lists, blocks = first_lists(units, n, scratch, k)
    graph = scratch.keep(merged(lists, k), "graph")
    blocks = scratch.keep(blocks, "blocks")
    for _ in range(rounds):
        new = scratch.keep(merged(graph.unionByName(descend(graph, blocks, k)), k), "graph")
        scratch.drop(graph)
        graph = new
    return graph, blocks


STATE = "qblock long, node long, x binary, ids array<long>, sims array<float>, expanded array<boolean>"


def search(starts: DataFrame, graph: DataFrame, blocks: DataFrame, n_queries: int, scratch: Scratch, hops: int = HOPS) -> DataFrame:
    """node (of a query), ids, sims: the best BEAM that a greedy search from the node's own list meets."""
    n_blocks = max(1, -(-n_queries // QUERIES))
    state = starts.join(blocks.select("node", "x"), "node").join(graph, "node", "left")
    state = state.select(
        F.pmod(F.xxhash64("node", F.lit(2)), F.lit(n_blocks)).alias("qblock"),
        "node",
        "x",
        F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"),
        F.coalesce("sims", F.array().cast("array<float>")).alias("sims"),
        F.transform(F.coalesce("ids", F.array().cast("array<bigint>")), lambda i: F.lit(False)).alias("expanded"),
    )
    state = scratch.keep(state, "beams")

    def advance(beams, fetched):
        import pyarrow as pa

        name = fetched["id"].to_numpy()
        order = np.argsort(name)
        name, x = name[order], as_matrix(fetched["x"])[order]
        rows = {c: [] for c in ("node", "x", "ids", "sims", "expanded")}
        for r in beams.to_pylist():
            ids, sims, done = np.array(r["ids"], np.int64), np.array(r["sims"], np.float32), np.array(r["expanded"], bool)
            open_ = np.flatnonzero(~done)
            done[open_[np.argsort(-sims[open_], kind="stable")[:EXPAND]]] = True
            near = np.unique(np.array(r["near"] or [], np.int64))
            near = near[~np.isin(near, ids) & (near != r["node"])]
            if len(near):
                met = x[np.searchsorted(name, near)] @ np.frombuffer(r["x"], np.float32)
                ids, sims, done = np.r_[ids, near], np.r_[sims, met], np.r_[done, np.zeros(len(near), bool)]
            top = np.argsort(-sims, kind="stable")[:BEAM]
            for c, v in (("node", r["node"]), ("x", r["x"]), ("ids", ids[top]), ("sims", sims[top].astype(np.float32)), ("expanded", done[top])):
                rows[c].append(v)
        types = {"node": pa.int64(), "x": pa.binary(), "ids": pa.list_(pa.int64()), "sims": pa.list_(pa.float32()), "expanded": pa.list_(pa.bool_())}
        block = beams["qblock"][0].as_py()
        return pa.table({"qblock": pa.array([block] * len(rows["node"]), pa.int64())} | {c: pa.array(v, types[c]) for c, v in rows.items()})

    for _ in range(hops):
        beam = F.arrays_zip("ids", "sims", "expanded")
        ranked = F.array_sort(F.filter(F.transform(beam, lambda b: F.struct((-b["sims"]).alias("d"), b["ids"].alias("i"), b["expanded"].alias("e"))), lambda b: ~b["e"]))
        front = state.select("qblock", F.col("node").alias("q"), F.explode(F.slice(ranked, 1, EXPAND)).alias("f")).select("qblock", "q", F.col("f.i").alias("node"))
        near = scratch.keep(front.join(graph.select("node", "ids"), "node").select("qblock", "q", F.explode("ids").alias("id")).distinct(), "near")
        if not near.limit(1).count():
            break
        fetched = near.select("qblock", "id").distinct().join(blocks.select(F.col("node").alias("id"), "x"), "id").select(F.col("qblock").alias("at"), "id", "x")
        grouped = near.groupBy("q").agg(F.collect_list("id").alias("near")).withColumnRenamed("q", "node")
        beams = state.join(grouped, "node", "left")
        new = scratch.keep(beams.groupBy("qblock").cogroup(fetched.groupBy("at")).applyInArrow(advance, STATE), "beams")
        scratch.drop(state)
        scratch.drop(near)
        state = new
    return state.select("node", "ids", "sims")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def error(dims: int) -> float:
    """What two float32 products of unit vectors of so many parts may be off, together."""
    return 2 * (dims + 2) * 2.0**-23


def nearest(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for rows with is_query (over vec_id), the k nearest other rows."""
    spark = rows.sparkSession
    small_batches(spark, 4096)
    scratch = Scratch(spark, "neighbours")
    found = vectors(rows)
    dims = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = scratch.keep(found.where(F.size("v") == dims["d"]), "vectors")
    units = scratch.keep(unit(own), "units")
    n = units.count()
    graph, blocks = build(units, n, scratch)
    queries = own.where(is_query)
    starts = queries.select("node").distinct()
    beams = scratch.keep(search(starts, graph, blocks, starts.count(), scratch), "found")
    # of a node's copies, the k + 1 smallest ids can be among the k nearest: by parts of a hash, then together
    part = Window.partitionBy("node", "part").orderBy("vec_id")
    whole = Window.partitionBy("node").orderBy("vec_id")
    members = own.select("node", "vec_id").distinct().withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    members = members.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1).select("node", "vec_id")
    # the beam's sims are float32: all that may be among the k nearest are scored again, and the node itself for its copies
    beam = F.transform(F.arrays_zip("ids", "sims"), lambda b: F.struct(b["sims"].alias("s"), b["ids"].alias("i")))
    kth = F.coalesce(F.get(F.sort_array(F.transform("sims", lambda s: -s)), F.lit(k - 1)), F.lit(9.0))  # minus the k-th best
    pick = F.filter(beam, lambda b: b["s"] >= -kth - error(dims["d"]))
    near = beams.select(F.col("node").alias("qnode"), F.explode(F.concat(F.array("node"), F.transform(pick, lambda b: b["i"]))).alias("node"))
    node_vectors = own.groupBy("node").agg(F.min("v").alias("v"))
    scored = near.join(node_vectors.select("node", "v"), "node").join(node_vectors.select(F.col("node").alias("qnode"), F.col("v").alias("qv")), "qnode")
    scored = scored.select("qnode", "node", cosine(F.col("qv"), F.col("v")).alias("score")).join(members, "node")
    pairs = queries.select(F.col("vec_id").alias("query_id"), F.col("node").alias("qnode")).join(scored, "qnode").where("query_id <> vec_id")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    scratch.drop_but(own, beams)
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
