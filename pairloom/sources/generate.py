"""Pairs of correlated random graphs.

A pair is (A, B, truth): B's vertices are relabelled by a random bijection, which truth (a, b) undoes.
Each possible edge is drawn on its own from hashed numbers, so a graph of any size is made in parallel
without a shuffle, and a lost task draws the same edges again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions.hashrng import uniform

STREAM_A, STREAM_B, STREAM_ORDER, STREAM_WEIGHT = 1, 2, 3, 4
SEED = 1234


@dataclass
class Pair:
    a: DataFrame  # src, dst
    b: DataFrame
    truth: DataFrame  # a, b
    vertices: DataFrame  # id


def possible_edges(spark: SparkSession, n: int, directed: bool = False, loops: bool = False) -> DataFrame:
    """i, j: the places at which an edge is drawn. A row a vertex is exploded; nothing is joined."""
    first = F.lit(0) if directed else F.col("id") + (0 if loops else 1)
    to = F.when(first <= n - 1, F.sequence(first.cast("bigint"), F.lit(n - 1).cast("bigint")))
    pairs = spark.range(n).select(F.col("id").alias("i"), F.explode(to).alias("j"))
    return pairs if loops or not directed else pairs.where("i <> j")


def draw(places: DataFrame, p: Column, rho: Column | float, seed: int = SEED) -> DataFrame:
    """places with in_a, in_b: A with chance p; B with chance p + rho (1 - p) where A has the edge, else p (1 - rho)."""
    rho = F.lit(float(rho)) if not isinstance(rho, Column) else rho
    ua, ub = uniform(F.col("i"), F.col("j"), seed, STREAM_A), uniform(F.col("i"), F.col("j"), seed, STREAM_B)
    drawn = places.withColumn("p", p.cast("double")).withColumn("in_a", ua < F.col("p"))
    return drawn.withColumn("in_b", ub < F.when(F.col("in_a"), F.col("p") + rho * (1 - F.col("p"))).otherwise(F.col("p") * (1 - rho)))


def both_ways(pairs: DataFrame, directed: bool = False) -> DataFrame:
    one = pairs.select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return one if directed else one.unionByName(pairs.where("i <> j").select(F.col("j").alias("src"), F.col("i").alias("dst")))


def permutation(vertices: DataFrame, seed: int = SEED, parts: int = 256) -> DataFrame:
    """label, old: a random order of the vertices; label x stands for vertex old.

    The random numbers are even, so that equal stretches of them are parts of about equal size: a vertex's
    label is its place in its part, and the sizes of the parts before.
    """
    u = uniform(F.col("id"), 0, seed, STREAM_ORDER)
    drawn = vertices.select("id", u.alias("u"), F.floor(u * parts).cast("int").alias("part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = drawn.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))  # parts rows at most
    place = F.row_number().over(Window.partitionBy("part").orderBy("u", "id")) - 1
    return drawn.withColumn("place", place).join(F.broadcast(sizes), "part").select((F.col("base") + F.col("place")).cast("bigint").alias("label"), F.col("id").alias("old"))


def invert(perm: DataFrame) -> DataFrame:
    """a, b: where each vertex went."""
    return perm.select(F.col("old").alias("a"), F.col("label").alias("b"))


def relabel(edges: DataFrame, truth: DataFrame) -> DataFrame:
    at = truth.select(F.col("a").alias("src"), F.col("b").alias("s"))
    to = truth.select(F.col("a").alias("dst"), F.col("b").alias("d"))
    return edges.join(at, "src").join(to, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def pair(spark: SparkSession, n: int, drawn: DataFrame, seed: int, directed: bool = False) -> Pair:
    vertices = spark.range(n)
    truth = invert(permutation(vertices, seed))
    return Pair(both_ways(drawn.where("in_a"), directed), relabel(both_ways(drawn.where("in_b"), directed), truth), truth, vertices)


def er_pair(spark: SparkSession, n: int = 600, p: float = 0.2, rho: float = 0.5, seed: int = SEED, directed: bool = False, loops: bool = False) -> Pair:
    """Uniform random graphs."""
    return pair(spark, n, draw(possible_edges(spark, n, directed, loops), F.lit(float(p)), rho, seed), seed, directed)


def block_of(v: Column, per_block: int) -> Column:
    return F.floor(v / per_block).cast("int")


#: Default chances between blocks.
BLOCK_PROBS = ((0.7, 0.3, 0.4), (0.3, 0.7, 0.3), (0.4, 0.3, 0.7))


def sbm_pair(spark: SparkSession, per_block: int = 200, n_blocks: int = 3, rho: float = 0.5, probs=BLOCK_PROBS, seed: int = SEED, directed: bool = False, loops: bool = False) -> Pair:
    """Stochastic block model: consecutive blocks of equal size."""
    n = per_block * n_blocks
    flat = F.array(*[F.lit(float(x)) for row in probs for x in row])
    p = F.get(flat, block_of(F.col("i"), per_block) * n_blocks + block_of(F.col("j"), per_block))
    return pair(spark, n, draw(possible_edges(spark, n, directed, loops), p, rho, seed), seed, directed)


def pareto_weights(spark: SparkSession, n: int = 600, alpha: float = 2.5, seed: int = SEED) -> DataFrame:
    """id, w: expected degrees; shrunk if the largest would give a chance over 1."""
    raw = spark.range(n).select("id", (F.pow(1 - uniform(F.col("id"), 0, seed, STREAM_WEIGHT), F.lit(-1.0 / alpha)) + 1).alias("w"))
    top = raw.agg(F.max("w").alias("m"), F.sum("w").alias("s"))
    factor = F.when(F.col("m") * F.col("m") / F.col("s") > 1, F.sqrt("s") / F.col("m") * 0.95).otherwise(1.0)
    return raw.withColumn("w", F.col("w") * top.select(factor).scalar())


def edge_probability(spark: SparkSession, n: int = 600, alpha: float = 2.5, noise: float = 0.0, seed: int = SEED, directed: bool = False, loops: bool = False) -> DataFrame:
    """i, j, p: product of the weights over their sum, plus noise, within [0, 1]."""
    w = pareto_weights(spark, n, alpha, seed)
    total = w.agg(F.sum("w")).scalar()
    i, j = w.select(F.col("id").alias("i"), F.col("w").alias("wi")), w.select(F.col("id").alias("j"), F.col("w").alias("wj"))
    places = possible_edges(spark, n, directed, loops).join(i, "i").join(j, "j")
    return places.select("i", "j", F.least(F.greatest(F.col("wi") * F.col("wj") / total + F.lit(float(noise)), F.lit(0.0)), F.lit(1.0)).alias("p"))


def powerlaw_pair(spark: SparkSession, n: int = 600, alpha: float = 2.5, rho: float = 0.8, seed: int = SEED, directed: bool = False, loops: bool = False) -> Pair:
    return pair(spark, n, draw(edge_probability(spark, n, alpha, 0.0, seed, directed, loops), F.col("p"), rho, seed), seed, directed)


def paper_pair(spark: SparkSession, n: int = 600, alpha: float = 2.5, p: float = 0.01, rho: float = 0.8, seed: int = SEED, directed: bool = False, loops: bool = False) -> Pair:
    """Power law plus uniform noise p."""
    return pair(spark, n, draw(edge_probability(spark, n, alpha, p, seed, directed, loops), F.col("p"), rho, seed), seed, directed)
