"""Which known pairs to use: strategies give a, b, seed_rank. With k = 0 all give none. Ties go to the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.hashrng import uniform

from . import scores

SEED, STREAM = 1234, 9


def top(scored: DataFrame, column: str, k: int) -> DataFrame:
    """a, seed_rank of the k largest."""
    best = scored.orderBy(F.desc(column), "id").limit(max(k, 0))
    rank = Window.orderBy(F.desc(column), "id")
    return best.select(F.col("id").alias("a"), F.row_number().over(rank).cast("bigint").alias("seed_rank"))  # k rows


def with_partner(chosen: DataFrame, truth: DataFrame) -> DataFrame:
    return chosen.join(truth, "a").select("a", "b", "seed_rank")


def by_score(scored: DataFrame, column: str, k: int, truth: DataFrame) -> DataFrame:
    return with_partner(top(scored, column, k), truth)


def drawn(id_: Column, seed: int = SEED) -> Column:
    return uniform(id_, 0, seed, STREAM)


def random(vertices: DataFrame, k: int, truth: DataFrame, seed: int = SEED) -> DataFrame:
    return by_score(vertices.select("id", (-drawn(F.col("id"), seed)).alias("u")), "u", k, truth)


def per_block(scored: DataFrame, order: list[Column], quota: Column) -> DataFrame:
    """scored (id, block, ...) with the first quota rows of each block."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(*order))).where(F.col("place") <= quota)


def blocked_random(vertices: DataFrame, k: int, truth: DataFrame, n_blocks: int = 3, seed: int = SEED) -> DataFrame:
    """vertices: id, block. k // n_blocks at random of each block, and the rest at random of all others."""
    marked = vertices.select("id", "block", drawn(F.col("id"), seed).alias("u"))
    own = per_block(marked, [F.col("u"), F.col("id")], F.lit(k // n_blocks)).select("id", "u", F.lit(0).alias("late"))
    rest = marked.join(own.select("id"), "id", "left_anti").orderBy("u", "id").limit(k % n_blocks).select("id", "u", F.lit(1).alias("late"))
    rank = Window.orderBy("late", "u", "id")
    both = own.unionByName(rest) if k > 0 else own.limit(0)
    return with_partner(both.select(F.col("id").alias("a"), F.row_number().over(rank).cast("bigint").alias("seed_rank")), truth)


def blocked_highest_degree(vertices: DataFrame, edges: DataFrame, k: int, truth: DataFrame, n_blocks: int = 3) -> DataFrame:
    """vertices: id, block (from 0). k // n_blocks of highest degree of each block, one more in the first k % n_blocks blocks."""
    scored = scores.degree(vertices.select("id"), edges).join(vertices, "id")
    quota = F.lit(k // n_blocks) + F.when(F.col("block") < k % n_blocks, 1).otherwise(0)
    chosen = per_block(scored, [F.desc("degree"), F.col("id")], quota)
    rank = Window.orderBy("block", "place")
    return with_partner(chosen.select(F.col("id").alias("a"), F.row_number().over(rank).cast("bigint").alias("seed_rank")), truth)


def highest_degree(vertices: DataFrame, edges: DataFrame, k: int, truth: DataFrame) -> DataFrame:
    return by_score(scores.degree(vertices, edges), "degree", k, truth)


def neighbor_degree(vertices: DataFrame, edges: DataFrame, k: int, truth: DataFrame) -> DataFrame:
    return by_score(scores.neighbor_degree(vertices, edges), "neighbor_degree", k, truth)


def jaccard(vertices: DataFrame, edges: DataFrame, k: int, truth: DataFrame) -> DataFrame:
    return by_score(scores.jaccard_neighborhood(vertices, edges), "jaccard", k, truth)


def triangle_ratio(vertices: DataFrame, edges: DataFrame, k: int, truth: DataFrame) -> DataFrame:
    return by_score(scores.triangle_degree_ratio(vertices, edges), "ratio", k, truth)


def betweenness(vertices: DataFrame, edges: DataFrame, k: int, truth: DataFrame) -> DataFrame:
    return by_score(scores.betweenness(vertices, edges), "betweenness", k, truth)


def invalid(seeds: DataFrame, truth: DataFrame) -> DataFrame:
    """Seeds that the truth does not have."""
    return seeds.join(truth, ["a", "b"], "left_anti").select("a", "b", "seed_rank")
