"""A pair of graphs from order lines: parts are vertices, and parts of one order are joined.

A leaves out lines returned (R), B those accepted (A); the lines common to both correlate them. B's
vertices carry other labels, by a bijection of the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .generate import Pair, relabel

FACTOR, SHIFT = 7, 13  # FACTOR must have no factor in common with the number of parts


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("id"), F.col("p_brand").alias("label"))


def edges(spark: SparkSession, sf_dir: str, without: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_returnflag") != without)
    lines = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").cast("bigint").alias("p")).distinct()
    one, two = lines.withColumnRenamed("p", "src"), lines.withColumnRenamed("p", "dst")
    return one.join(two, "o").where("src <> dst").select("src", "dst").distinct()


def coorder_pair(spark: SparkSession, sf_dir: str) -> Pair:
    vertices = parts(spark, sf_dir)
    n = vertices.agg(F.count(F.lit(1))).scalar()
    truth = vertices.select(F.col("id").alias("a"), ((F.col("id") * FACTOR + SHIFT) % n).alias("b"))
    return Pair(edges(spark, sf_dir, "R"), relabel(edges(spark, sf_dir, "A"), truth), truth, vertices.select("id"))


def coorder_sql() -> str:
    """The pair's tables as DuckDB CTEs: vertices, edges (A), truth, edges_b."""
    side = lambda name, flag: f"""{name}_l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag <> '{flag}'),
{name} AS (SELECT DISTINCT x.p AS src, y.p AS dst FROM {name}_l x JOIN {name}_l y ON x.o = y.o AND x.p <> y.p)"""  # noqa: E731
    return f"""vertices AS (SELECT p_partkey AS id FROM part),
truth AS (SELECT id AS a, (id * {FACTOR} + {SHIFT}) % (SELECT count(*) FROM part) AS b FROM vertices),
{side("edges", "R")},
{side("raw_b", "A")},
edges_b AS (SELECT s.b AS src, d.b AS dst FROM raw_b JOIN truth s ON src = s.a JOIN truth d ON dst = d.a)"""
