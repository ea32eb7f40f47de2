"""The relational part of seeded quadratic matching: its constant term and its first gradient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import percolation


def seed_term(a: DataFrame, b: DataFrame, seeds: DataFrame) -> DataFrame:
    """i, j, term: twice the number of seeds that i and j are neighbours of, for unseeded i and j; no row is 0."""
    return percolation.marks(a, b, seeds).select("i", "j", (2 * F.col("marks")).cast("bigint").alias("term"))


def unseeded_degree(vertices: DataFrame, edges: DataFrame, seeded: DataFrame) -> DataFrame:
    """id, d: degrees within the unseeded vertices. seeded: id."""
    left = vertices.join(seeded, "id", "left_anti")
    inside = edges.join(seeded.select(F.col("id").alias("src")), "src", "left_anti").join(seeded.select(F.col("id").alias("dst")), "dst", "left_anti")
    n = inside.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    return left.join(n, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))


def first_direction(vertices: DataFrame, a: DataFrame, b: DataFrame, seeds: DataFrame) -> DataFrame:
    """i, j, gradient: for each unseeded i, the j of the largest gradient at the barycentre (the smaller j on ties).

    The gradient is the seed term and 2/m times the product of the degrees. So a row's best place is one with
    a seed term, or the j of the largest degree: no other place need be made. Rows all 0 are left out.
    """
    da = unseeded_degree(vertices, a, seeds.select(F.col("a").alias("id"))).select(F.col("id").alias("i"), F.col("d").alias("da"))
    db = unseeded_degree(vertices, b, seeds.select(F.col("b").alias("id"))).select(F.col("id").alias("j"), F.col("d").alias("db"))
    m = da.agg(F.count(F.lit(1))).scalar()
    top = db.agg(F.max(F.struct("db", (-F.col("j")).alias("j"))).alias("x"))
    flat = da.where("da > 0").select("i", (-top.select("x.j").scalar()).alias("j"), "da", top.select("x.db").scalar().alias("db"), F.lit(0).cast("bigint").alias("term")).where("db > 0")
    termed = seed_term(a, b, seeds).join(da, "i").join(db, "j").select("i", "j", "da", "db", "term")
    places = termed.unionByName(flat).select("i", "j", F.round(F.col("term") + 2.0 / m * F.col("da") * F.col("db"), 9).alias("gradient"))
    best = places.groupBy("i").agg(F.min(F.struct((-F.col("gradient")).alias("g"), "j")).alias("x"))
    return best.select("i", F.col("x.j").alias("j"), F.round(-F.col("x.g"), 6).alias("gradient"))
