"""The reference-level queries, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import sinks
from pairloom.functions.hashrng import uniform, uniform_sql
from pairloom.operators import percolation, scores, seeds, sgm
from pairloom.session import checkpoints, ship
from pairloom.sources import coorder, generate
from pairloom.sources.generate import Pair

from . import experiments, stats
from .experiments import Runner

K = 20
N_BLOCKS = 25  # brands
SMALL_N, SMALL_P = 100, 0.06  # the graph of the path queries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(ship(spark), sf_dir)
        if sql:
            ORACLES[key] = sql
        return f

    return add


# Generators

U = uniform_sql
SEED, SA, SB, SO, SW = generate.SEED, generate.STREAM_A, generate.STREAM_B, generate.STREAM_ORDER, generate.STREAM_WEIGHT


def pair_rows(p: Pair) -> DataFrame:
    side = lambda df, name: df.select(F.lit(name).alias("side"), "src", "dst")
    return side(p.a, "A").unionByName(side(p.b, "B"))


def drawn_sql(n: int, places: str, rho: float) -> str:
    """CTEs from places (i, j, p) to the pair's rows."""
    return f"""
places AS ({places}),
one AS (SELECT i, j, p, {U("i", "j", SEED, SA)} < p AS in_a, {U("i", "j", SEED, SB)} AS ub FROM places),
drawn AS (SELECT *, ub < CASE WHEN in_a THEN p + {rho}::DOUBLE * (1 - p) ELSE p * (1 - {rho}::DOUBLE) END AS in_b FROM one),
truth AS (SELECT id AS a, row_number() OVER (ORDER BY {U("id", 0, SEED, SO)}, id) - 1 AS b FROM (SELECT unnest(range({n})) AS id)),
both_a AS (SELECT i AS src, j AS dst FROM drawn WHERE in_a UNION ALL SELECT j, i FROM drawn WHERE in_a),
both_b AS (SELECT i AS src, j AS dst FROM drawn WHERE in_b UNION ALL SELECT j, i FROM drawn WHERE in_b)"""


PAIR_ROWS = "SELECT 'A' AS side, src, dst FROM both_a UNION ALL SELECT 'B', s.b, d.b FROM both_b JOIN truth s ON src = s.a JOIN truth d ON dst = d.a"


def all_pairs(n: int) -> str:
    return f"(SELECT x.i, y.j FROM (SELECT unnest(range({n})) AS i) x JOIN (SELECT unnest(range({n})) AS j) y ON i < j)"


def er_sql(n: int, p: float, rho: float) -> str:
    return f"WITH {drawn_sql(n, f'SELECT i, j, {p}::DOUBLE AS p FROM {all_pairs(n)}', rho)}"


@query(f"{er_sql(600, 0.2, 0.5)} {PAIR_ROWS}")
def gen_er_pair(spark, sf_dir):
    return pair_rows(generate.er_pair(spark))


BLOCK_CASE = "CASE " + " ".join(f"WHEN i // 200 = {x} AND j // 200 = {y} THEN {v}::DOUBLE" for x, row in enumerate(generate.BLOCK_PROBS) for y, v in enumerate(row)) + " END"


@query(f"WITH {drawn_sql(600, f'SELECT i, j, {BLOCK_CASE} AS p FROM {all_pairs(600)}', 0.5)} {PAIR_ROWS}")
def gen_sbm_pair(spark, sf_dir):
    return pair_rows(generate.sbm_pair(spark))


def weights_sql(n: int, alpha: float) -> str:
    return f"""raw AS (SELECT id, pow(1 - {U("id", 0, SEED, SW)}, {-1.0 / alpha}::DOUBLE) + 1 AS w FROM (SELECT unnest(range({n})) AS id)),
weights AS (SELECT id, w * (SELECT CASE WHEN max(w) * max(w) / sum(w) > 1 THEN sqrt(sum(w)) / max(w) * 0.95::DOUBLE ELSE 1 END FROM raw) AS w FROM raw)"""


def heavy_places(n: int, noise: float) -> str:
    return f"SELECT i, j, least(greatest(x.w * y.w / (SELECT sum(w) FROM weights) + {noise}::DOUBLE, 0), 1) AS p FROM {all_pairs(n)} JOIN weights x ON i = x.id JOIN weights y ON j = y.id"


@query(f"WITH {weights_sql(600, 2.5)}, {drawn_sql(600, heavy_places(600, 0.0), 0.8)} {PAIR_ROWS}")
def gen_powerlaw_pair(spark, sf_dir):
    return pair_rows(generate.powerlaw_pair(spark))


@query(f"WITH {weights_sql(600, 2.5)}, {drawn_sql(600, heavy_places(600, 0.01), 0.8)} {PAIR_ROWS}")
def gen_paper_pair(spark, sf_dir):
    return pair_rows(generate.paper_pair(spark))


@query(f"{er_sql(600, 0.2, 0.5)} SELECT i, j, in_a, in_b FROM drawn WHERE in_a OR in_b")
def correlated_edges(spark, sf_dir):
    drawn = generate.draw(generate.possible_edges(spark, 600), F.lit(0.2), 0.5)
    return drawn.where("in_a or in_b").select("i", "j", "in_a", "in_b")


@query(f"WITH {weights_sql(600, 2.5)} SELECT id, round(w, 9) AS w FROM weights")
def pareto_weights(spark, sf_dir):
    return generate.pareto_weights(spark).select("id", F.round("w", 9).alias("w"))


@query(f"WITH {weights_sql(600, 2.5)} SELECT i, j, round(p, 9) AS p FROM ({heavy_places(600, 0.0)})")
def edge_probability(spark, sf_dir):
    return generate.edge_probability(spark).select("i", "j", F.round("p", 9).alias("p"))


@query(f"SELECT row_number() OVER (ORDER BY {U('id', 0, SEED, SO)}, id) - 1 AS label, id AS old FROM (SELECT unnest(range(600)) AS id)")
def vertex_permutation(spark, sf_dir):
    return generate.permutation(spark.range(600))


@query(f"SELECT id AS a, row_number() OVER (ORDER BY {U('id', 0, SEED, SO)}, id) - 1 AS b FROM (SELECT unnest(range(600)) AS id)")
def invert_permutation(spark, sf_dir):
    return generate.invert(generate.permutation(spark.range(600)))


def catalog_sql() -> str:
    rows = []
    for s in experiments.SCENARIOS:
        params = ",".join(f"{k}={v:.4f}" for k, v in sorted(s.params.items()))
        probs = "" if s.block_probs is None else ",".join(f"{x:.4f}" for row in s.block_probs for x in row)
        rows.append(f"SELECT '{s.name}' AS name, '{s.family}' AS family, '{s.algorithm}' AS algorithm, '{params}' AS params, '{probs}' AS block_probs, '{','.join(s.strategies)}' AS strategies, '{','.join(map(str, s.seed_numbers))}' AS seed_numbers, {s.trials} AS trials")
    return " UNION ALL ".join(rows)


@query(catalog_sql())
def scenario_catalog(spark, sf_dir):
    number = lambda x: F.format_string("%.4f", x)
    params = F.array_join(F.array_sort(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), number(e["value"])))), ",")
    probs = F.coalesce(F.array_join(F.transform(F.flatten("block_probs"), number), ","), F.lit(""))
    joined = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("strategies", "seed_numbers")]
    return experiments.catalog(spark).select("name", "family", "algorithm", params.alias("params"), probs.alias("block_probs"), *joined, "trials")


# The co-order graphs

PAIR_SQL = coorder.coorder_sql()
G = f"WITH {PAIR_SQL}"


def pair(spark: SparkSession, sf_dir: str) -> Pair:
    return coorder.coorder_pair(spark, sf_dir)


@query(f"{G} SELECT src, dst FROM edges")
def edges_from_lineitem(spark, sf_dir):
    return pair(spark, sf_dir).a


@query(f"{G} SELECT src, dst FROM edges_b")
def relabel_graph(spark, sf_dir):
    return pair(spark, sf_dir).b


DEGREE = "degree AS (SELECT id, count(dst) AS degree FROM vertices LEFT JOIN edges ON id = src GROUP BY id)"


@query(f"{G}, {DEGREE} SELECT * FROM degree")
def degree(spark, sf_dir):
    p = pair(spark, sf_dir)
    return scores.degree(p.vertices, p.a)


NEIGHBOR = f"{DEGREE}, scored AS (SELECT v.id, CAST(coalesce(sum(d.degree), 0) AS BIGINT) AS neighbor_degree FROM vertices v LEFT JOIN edges ON v.id = src LEFT JOIN degree d ON dst = d.id GROUP BY v.id)"


@query(f"{G}, {NEIGHBOR} SELECT * FROM scored")
def neighbor_degree(spark, sf_dir):
    p = pair(spark, sf_dir)
    return scores.neighbor_degree(p.vertices, p.a)


TRIANGLES = """tri AS (SELECT x.src AS u, x.dst AS v, y.dst AS w FROM edges x JOIN edges y ON x.dst = y.src AND x.src < x.dst AND y.src < y.dst JOIN edges z ON z.src = x.src AND z.dst = y.dst),
triangles AS (SELECT id, count(u) AS triangles FROM vertices LEFT JOIN (SELECT u AS t, u FROM tri UNION ALL SELECT v, u FROM tri UNION ALL SELECT w, u FROM tri) ON id = t GROUP BY id)"""


@query(f"{G}, {TRIANGLES} SELECT * FROM triangles")
def triangles(spark, sf_dir):
    p = pair(spark, sf_dir)
    return scores.triangles(p.vertices, p.a)


RATIO = f"{DEGREE}, {TRIANGLES}, scored AS (SELECT id, degree / (triangles + 1) AS ratio FROM degree JOIN triangles USING (id))"


@query(f"{G}, {RATIO} SELECT * FROM scored")
def triangle_degree_ratio(spark, sf_dir):
    p = pair(spark, sf_dir)
    return scores.triangle_degree_ratio(p.vertices, p.a)


JACCARD = f"""{DEGREE}, common AS (SELECT x.src AS u, y.src AS v, count(*) AS c FROM edges x JOIN edges y ON x.dst = y.dst GROUP BY 1, 2),
each AS (SELECT src, coalesce(c, 0) / (p.degree + q.degree - coalesce(c, 0)) AS s FROM edges JOIN degree p ON src = p.id JOIN degree q ON dst = q.id LEFT JOIN common ON src = u AND dst = v),
scored AS (SELECT id, round(coalesce(avg(s), 0), {scores.DIGITS}) AS jaccard FROM vertices LEFT JOIN each ON id = src GROUP BY id)"""


@query(f"{G}, {JACCARD} SELECT * FROM scored")
def jaccard_neighborhood(spark, sf_dir):
    p = pair(spark, sf_dir)
    return scores.jaccard_neighborhood(p.vertices, p.a)


@query(f"{G} SELECT id, array_to_string(coalesce(list(dst ORDER BY dst) FILTER (dst IS NOT NULL), []), ',') AS neighbors FROM vertices LEFT JOIN edges ON id = src GROUP BY id")
def adjacency_list(spark, sf_dir):
    p = pair(spark, sf_dir)
    return scores.adjacency_list(p.vertices, p.a).select("id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


SMALL = f"{er_sql(SMALL_N, SMALL_P, 0.5)}, vertices AS (SELECT unnest(range({SMALL_N})) AS id), edges AS (SELECT * FROM both_a)"
LEVELS = 12  # more than the small graph's diameter


def levels_sql() -> str:
    out = ["l0 AS (SELECT id AS s, id AS v, 0 AS dist, 1::BIGINT AS sigma FROM vertices)", "seen0 AS MATERIALIZED (SELECT * FROM l0)"]
    for d in range(1, LEVELS + 1):
        out.append(f"l{d} AS MATERIALIZED (SELECT s, dst AS v, {d} AS dist, CAST(sum(sigma) AS BIGINT) AS sigma FROM l{d - 1} JOIN edges ON v = src WHERE NOT EXISTS (SELECT 1 FROM seen{d - 1} q WHERE q.s = l{d - 1}.s AND q.v = dst) GROUP BY s, dst)")
        out.append(f"seen{d} AS MATERIALIZED (SELECT * FROM seen{d - 1} UNION ALL SELECT * FROM l{d})")
    return ", ".join(out)


def small_graph(spark: SparkSession) -> Pair:
    checkpoints(spark)
    return generate.er_pair(spark, SMALL_N, SMALL_P, 0.5)


@query(f"{SMALL}, {levels_sql()} SELECT s, v, CAST(dist AS BIGINT) AS dist, sigma FROM seen{LEVELS}")
def bfs_path_counts(spark, sf_dir):
    p = small_graph(spark)
    return scores.bfs_levels(p.vertices, p.a)


def dependencies_sql() -> str:
    out = [f"d{LEVELS} AS (SELECT s, v, sigma, 0::DOUBLE AS delta FROM l{LEVELS})"]
    for d in range(LEVELS - 1, 0, -1):
        out.append(f"d{d} AS MATERIALIZED (SELECT l.s, l.v, l.sigma, coalesce(sum(l.sigma * (1 + n.delta) / n.sigma), 0) AS delta FROM l{d} l LEFT JOIN (SELECT e.src, n.* FROM edges e JOIN d{d + 1} n ON e.dst = n.v) n ON n.s = l.s AND n.src = l.v GROUP BY 1, 2, 3)")
    return ", ".join(out)


BETWEENNESS = f"""{levels_sql()}, {dependencies_sql()},
scored AS (SELECT id, round(coalesce(sum(delta), 0) / (({SMALL_N} - 1) * ({SMALL_N} - 2)), {scores.DIGITS}) AS betweenness FROM vertices LEFT JOIN ({" UNION ALL ".join(f"SELECT v, delta FROM d{d}" for d in range(1, LEVELS + 1))}) ON id = v GROUP BY id)"""


@query(f"{SMALL}, {BETWEENNESS} SELECT * FROM scored")
def betweenness(spark, sf_dir):
    p = small_graph(spark)
    return scores.betweenness(p.vertices, p.a)


@query()
def betweenness_coorder(spark, sf_dir):
    p = pair(spark, sf_dir)
    return scores.betweenness(p.vertices, p.a)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


DISTANCE = "sqrt(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))"


@query(f"SELECT x.vec_id AS i, y.vec_id AS j, round({DISTANCE}, 6) AS distance FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id")
def pairwise_distance(spark, sf_dir):
    return scores.pairwise_distance(points(spark, sf_dir))


@query(f"SELECT x.vec_id AS id, round(min({DISTANCE}), 6) AS distance FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id GROUP BY 1")
def nn_distance(spark, sf_dir):
    return scores.nn_distance(points(spark, sf_dir))


@query()
def spectral_embedding(spark, sf_dir):
    """Distances to the nearest point in the embedding of each of the generated graphs: signs and turns are free, distances are not."""

    def embed(batches):
        import numpy as np
        import pandas as pd

        from pairloom.kernels import graphs

        for batch in batches:
            for g in batch["id"]:
                a, _, _ = graphs.er(np.random.default_rng([SEED, int(g)]), n=600, p=0.2)
                yield pd.DataFrame({"graph": int(g), "id": np.arange(len(a)), "uniqueness": graphs.spectral_unique(a)})

    return spark.range(4).repartition(4).mapInPandas(embed, "graph bigint, id bigint, uniqueness double")


# Seeds


def top_sql(column: str, k: int = K) -> str:
    return f"""SELECT a, b, seed_rank FROM (SELECT id AS a, row_number() OVER (ORDER BY {column} DESC, id) AS seed_rank FROM scored) JOIN truth USING (a) WHERE seed_rank <= {k}"""


DRAWN = U("id", 0, seeds.SEED, seeds.STREAM)
RANDOM = f"scored AS (SELECT id, -{DRAWN} AS u FROM vertices)"


@query(f"{G}, {RANDOM} {top_sql('u')}")
def seeds_random(spark, sf_dir):
    p = pair(spark, sf_dir)
    return seeds.random(p.vertices, K, p.truth)


HIGHEST = f"{DEGREE}, scored AS (SELECT * FROM degree)"


@query(f"{G}, {HIGHEST} {top_sql('degree')}")
def seeds_highest_degree(spark, sf_dir):
    p = pair(spark, sf_dir)
    return seeds.highest_degree(p.vertices, p.a, K, p.truth)


@query(f"{G}, {NEIGHBOR} {top_sql('neighbor_degree')}")
def seeds_neighbor_degree(spark, sf_dir):
    p = pair(spark, sf_dir)
    return seeds.neighbor_degree(p.vertices, p.a, K, p.truth)


@query(f"{G}, {JACCARD} {top_sql('jaccard')}")
def seeds_jaccard(spark, sf_dir):
    p = pair(spark, sf_dir)
    return seeds.jaccard(p.vertices, p.a, K, p.truth)


@query(f"{G}, {RATIO} {top_sql('ratio')}")
def seeds_triangle_ratio(spark, sf_dir):
    p = pair(spark, sf_dir)
    return seeds.triangle_ratio(p.vertices, p.a, K, p.truth)


@query(f"{SMALL}, {BETWEENNESS} {top_sql('betweenness')}")
def seeds_betweenness(spark, sf_dir):
    p = small_graph(spark)
    return seeds.betweenness(p.vertices, p.a, K, p.truth)


@query()
def seeds_betweenness_coorder(spark, sf_dir):
    """No SQL: unrolled levels over the whole pair are too dear. A test holds it to brute force."""
    p = pair(spark, sf_dir)
    return seeds.betweenness(p.vertices, p.a, K, p.truth)


def branded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, block: parts by brand, from 0 in the order of the brands' names."""
    parts = coorder.parts(spark, sf_dir)
    from pyspark.sql import Window

    names = parts.select("label").distinct()
    numbered = names.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("block"))  # a row a brand
    return parts.join(numbered, "label").select("id", "block")


BLOCKS = "blocks AS (SELECT p_partkey AS id, dense_rank() OVER (ORDER BY p_brand) - 1 AS block FROM part)"
KB = 60


def n_brands(spark: SparkSession, sf_dir: str) -> int:
    return coorder.parts(spark, sf_dir).select("label").distinct().count()


@query(f"""{G}, {BLOCKS}, nb AS (SELECT count(DISTINCT block) AS nb FROM blocks), drawn AS (SELECT id, block, {DRAWN} AS u FROM blocks),
own AS (SELECT id, u, 0 AS late FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY u, id) AS place FROM drawn) WHERE place <= {KB} // (SELECT nb FROM nb)),
rest AS (SELECT id, u, 1 AS late FROM (SELECT *, row_number() OVER (ORDER BY u, id) AS place FROM drawn WHERE id NOT IN (SELECT id FROM own)) WHERE place <= {KB} % (SELECT nb FROM nb)),
ranked AS (SELECT id AS a, row_number() OVER (ORDER BY late, u, id) AS seed_rank FROM (SELECT * FROM own UNION ALL SELECT * FROM rest))
SELECT a, b, seed_rank FROM ranked JOIN truth USING (a)""")
def seeds_blocked_random(spark, sf_dir):
    return seeds.blocked_random(branded(spark, sf_dir), KB, pair(spark, sf_dir).truth, n_brands(spark, sf_dir))


@query(f"""{G}, {BLOCKS}, {DEGREE}, nb AS (SELECT count(DISTINCT block) AS nb FROM blocks),
placed AS (SELECT id, block, row_number() OVER (PARTITION BY block ORDER BY degree DESC, id) AS place FROM degree JOIN blocks USING (id)),
own AS (SELECT * FROM placed WHERE place <= {KB} // (SELECT nb FROM nb) + CASE WHEN block < {KB} % (SELECT nb FROM nb) THEN 1 ELSE 0 END)
SELECT a, b, seed_rank FROM (SELECT id AS a, row_number() OVER (ORDER BY block, place) AS seed_rank FROM own) JOIN truth USING (a)""")
def seeds_blocked_highest_degree(spark, sf_dir):
    p = pair(spark, sf_dir)
    return seeds.blocked_highest_degree(branded(spark, sf_dir), p.a, KB, p.truth, n_brands(spark, sf_dir))


@query()
def seeds_spectral_unique(spark, sf_dir):
    """With the partners that the generated graph's order gives."""

    def truth(batches):
        import numpy as np
        import pandas as pd

        from pairloom.kernels import graphs

        for batch in batches:
            for g in batch["id"]:
                _, _, to = graphs.er(np.random.default_rng([SEED, int(g)]), n=600, p=0.2)
                yield pd.DataFrame({"a": np.arange(len(to)), "b": to})

    scored = spectral_embedding(spark, sf_dir).where("graph = 0").select("id", F.round("uniqueness", 9).alias("u"))
    return seeds.by_score(scored, "u", K, spark.range(1).mapInPandas(truth, "a bigint, b bigint"))


@query(f"{G}, {HIGHEST} {top_sql('degree')}")
def seed_pairs(spark, sf_dir):
    p = pair(spark, sf_dir)
    return seeds.with_partner(seeds.top(scores.degree(p.vertices, p.a), "degree", K), p.truth)


@query(f"{G}, {HIGHEST}, s AS ({top_sql('degree')}), moved AS (SELECT a, b + a % 2 AS b, seed_rank FROM s) SELECT a, b, seed_rank FROM moved WHERE a % 2 = 1")
def invalid_seeds(spark, sf_dir):
    """Every second seed gets a wrong partner; the check finds those."""
    s = seed_pairs(spark, sf_dir).withColumn("b", F.col("b") + F.col("a") % 2)
    return seeds.invalid(s, pair(spark, sf_dir).truth)


# Matching, a step at a time

SEEDED = f"{G}, {HIGHEST}, seeds AS MATERIALIZED ({top_sql('degree')})"
MARKS = "marks AS (SELECT x.dst AS i, y.dst AS j, count(*) AS marks FROM seeds s JOIN edges x ON x.src = s.a JOIN edges_b y ON y.src = s.b WHERE x.dst NOT IN (SELECT a FROM seeds) AND y.dst NOT IN (SELECT b FROM seeds) GROUP BY 1, 2)"


def seeded(spark: SparkSession, sf_dir: str) -> tuple[Pair, DataFrame]:
    p = pair(spark, sf_dir)
    return p, seeds.highest_degree(p.vertices, p.a, K, p.truth)


@query(f"{SEEDED}, {MARKS} SELECT i, j, marks FROM marks")
def percolation_marks(spark, sf_dir):
    p, s = seeded(spark, sf_dir)
    return percolation.marks(p.a, p.b, s)


GAP = "gap AS (SELECT m.*, abs(p.n - q.n) AS degree_gap FROM marks m JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) p ON i = p.src JOIN (SELECT src, count(*) AS n FROM edges_b GROUP BY 1) q ON j = q.src)"


@query(f"{SEEDED}, {MARKS}, {GAP} SELECT i, j, marks, degree_gap FROM gap WHERE marks >= 2 ORDER BY marks DESC, degree_gap, i, j LIMIT 1")
def percolation_first_match(spark, sf_dir):
    p, s = seeded(spark, sf_dir)
    return percolation.first_match(percolation.marks(p.a, p.b, s), p.vertices, p.a, p.b)


@query(f"{SEEDED}, {MARKS} SELECT i AS a, j AS b FROM marks WHERE marks < 2")
def percolation_expand_candidates(spark, sf_dir):
    p, s = seeded(spark, sf_dir)
    return percolation.expansion(percolation.marks(p.a, p.b, s))


@query(f"""{SEEDED}, {MARKS}, {GAP}, ready AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY marks DESC, degree_gap, j) AS ri, row_number() OVER (PARTITION BY j ORDER BY marks DESC, degree_gap, i) AS rj FROM gap WHERE marks >= 2)
SELECT i AS a, j AS b FROM ready WHERE ri = 1 AND rj = 1""")
def percolation_mutual_round(spark, sf_dir):
    p, s = seeded(spark, sf_dir)
    return percolation.mutual_best_round(percolation.marks(p.a, p.b, s), p.vertices, p.a, p.b)


TERM = "term AS (SELECT i, j, 2 * marks AS term FROM marks)"


@query(f"{SEEDED}, {MARKS}, {TERM} SELECT i, j, term FROM term")
def sgm_seed_term(spark, sf_dir):
    p, s = seeded(spark, sf_dir)
    return sgm.seed_term(p.a, p.b, s)


def inner_degree(name: str, table: str, key: str) -> str:
    return f"{name} AS (SELECT id, count(dst) AS d FROM vertices LEFT JOIN (SELECT * FROM {table} WHERE src NOT IN (SELECT {key} FROM seeds) AND dst NOT IN (SELECT {key} FROM seeds)) ON id = src WHERE id NOT IN (SELECT {key} FROM seeds) GROUP BY id)"


GRADIENT = f"""{TERM}, {inner_degree("da", "edges", "a")}, {inner_degree("db", "edges_b", "b")},
flat AS (SELECT x.id AS i, y.id AS j, 2.0::DOUBLE / (SELECT count(*) FROM da) * x.d * y.d AS flat FROM da x, db y WHERE x.d > 0 AND y.d > 0),
gradient AS (SELECT coalesce(t.i, f.i) AS i, coalesce(t.j, f.j) AS j, round(coalesce(term, 0) + coalesce(flat, 0), 9) AS gradient FROM flat f FULL JOIN term t ON f.i = t.i AND f.j = t.j)"""


@query(f"{SEEDED}, {MARKS}, {GRADIENT} SELECT i, j, round(gradient, 6) AS gradient FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY gradient DESC, j) AS r FROM gradient) WHERE r = 1")
def sgm_gradient0(spark, sf_dir):
    """The largest place of each row of the first gradient."""
    p, s = seeded(spark, sf_dir)
    return sgm.first_direction(p.vertices, p.a, p.b, s)


@query()
def percolation_match(spark, sf_dir):
    """Batched percolation over the whole co-order pair."""
    checkpoints(spark)
    p, s = seeded(spark, sf_dir)
    keep = lambda df: df.checkpoint()  # noqa: E731  read in each round
    return percolation.percolate(keep(p.vertices), keep(p.a), keep(p.b), keep(s))


@query(f"{SEEDED}, guess AS (SELECT a, CASE WHEN a % 3 = 0 THEN NULL WHEN a % 3 = 1 THEN b ELSE b + 1 END AS b FROM truth) SELECT avg(CASE WHEN g.b = t.b THEN 1::DOUBLE ELSE 0 END) AS match_ratio FROM truth t JOIN guess g USING (a)")
def match_ratio(spark, sf_dir):
    p = pair(spark, sf_dir)
    return percolation.match_ratio(p.truth, guess(p))


def guess(p: Pair) -> DataFrame:
    third = F.col("a") % 3
    return p.truth.select("a", F.when(third == 1, F.col("b")).when(third == 2, F.col("b") + 1).alias("b"))


@query(f"{SEEDED}, guess AS (SELECT a, CASE WHEN a % 3 = 0 THEN NULL WHEN a % 3 = 1 THEN b ELSE b + 1 END AS b FROM truth) SELECT avg(CASE WHEN g.b = t.b THEN 1::DOUBLE ELSE 0 END) AS match_ratio_unseeded FROM truth t JOIN guess g USING (a) WHERE a NOT IN (SELECT a FROM seeds)")
def match_ratio_unseeded(spark, sf_dir):
    p, s = seeded(spark, sf_dir)
    return percolation.match_ratio_unseeded(p.truth, guess(p), s)


# Statistics, over facts and records made of hashed numbers

SF, SR = 21, 22
COUNTS = [2, 4, 8]


def facts(spark: SparkSession) -> DataFrame:
    grid = spark.range(4).select(F.col("id").alias("s"), F.explode(F.array(*[F.lit(k) for k in COUNTS])).alias("seed_count"))
    grid = grid.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(20))))
    u = uniform(F.col("s") * 100 + F.col("seed_count"), F.col("trial"), SEED, SF)
    return grid.select(F.lit("made").alias("scenario"), F.format_string("strategy %d", "s").alias("strategy"), F.lit("sgm").alias("algorithm"), "seed_count", "trial", F.round(u, 4).alias("accuracy"), u.alias("cpu_seconds"))


FACTS = f"""WITH facts AS (SELECT 'made' AS scenario, 'strategy ' || s AS strategy, 'sgm' AS algorithm, seed_count, trial, round({U("s * 100 + seed_count", "trial", SEED, SF)}, 4) AS accuracy
FROM (SELECT unnest(range(4)) AS s), (SELECT unnest({COUNTS}) AS seed_count), (SELECT unnest(range(1, 21)) AS trial))"""


def records(spark: SparkSession) -> DataFrame:
    grid = spark.range(4).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(1), F.lit(50))).alias("trial"))
    h0 = F.when(F.col("s") == 3, 0.5).otherwise(F.round(uniform(F.col("s"), F.col("trial"), SEED, SR), 2))
    final = F.least(F.lit(1.0), F.round(F.col("H0") + uniform(F.col("s"), F.col("trial"), SEED, SR + 1) / 2, 2))
    one = grid.withColumn("H0", h0).withColumn("final_unseeded", final)
    return one.select(F.format_string("strategy %d", "s").alias("strategy"), "trial", "H0", "final_unseeded", F.round((F.col("final_unseeded") * 280 + 20) / 300, 9).alias("final_all"), F.round(uniform(F.col("s"), F.col("trial"), SEED, SR + 2), 3).alias("alpha0"))


RECORDS = f"""WITH one AS (SELECT s, trial, CASE WHEN s = 3 THEN 0.5::DOUBLE ELSE round({U("s", "trial", SEED, SR)}, 2) END AS H0, {U("s", "trial", SEED, SR + 1)} AS v, round({U("s", "trial", SEED, SR + 2)}, 3) AS alpha0
FROM (SELECT unnest(range(4)) AS s), (SELECT unnest(range(1, 51)) AS trial)),
two AS (SELECT *, least(1::DOUBLE, round(H0 + v / 2, 2)) AS final_unseeded FROM one),
records AS (SELECT 'strategy ' || s AS strategy, trial, H0, final_unseeded, round((final_unseeded * 280 + 20) / 300, 9) AS final_all, alpha0 FROM two),
ranked AS (SELECT *, rank() OVER (PARTITION BY strategy ORDER BY H0) + (count(*) OVER (PARTITION BY strategy, H0) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY strategy ORDER BY final_unseeded) + (count(*) OVER (PARTITION BY strategy, final_unseeded) - 1) / 2.0::DOUBLE AS ry FROM records)"""
CORR = lambda x, y: f"round(CASE WHEN stddev_pop({x}) > 1e-8 AND stddev_pop({y}) > 1e-8 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END, 9)"
CI = "count(*) AS n, round(avg(accuracy), 9) AS mean, round(stddev_pop(accuracy), 9) AS std, round(coalesce(stddev_samp(accuracy) / sqrt(count(*)), 0), 9) AS sem"
BOUNDS = "round(avg(accuracy) - 1.96::DOUBLE * coalesce(stddev_samp(accuracy) / sqrt(count(*)), 0), 9) AS low, round(avg(accuracy) + 1.96::DOUBLE * coalesce(stddev_samp(accuracy) / sqrt(count(*)), 0), 9) AS high"


@query(f"{FACTS} SELECT strategy, {CI} FROM facts GROUP BY strategy")
def accuracy_summary(spark, sf_dir):
    return stats.accuracy_ci(facts(spark), ["strategy"]).drop("low", "high")


@query(f"{FACTS} SELECT scenario, strategy, algorithm, seed_count, {CI}, {BOUNDS} FROM facts GROUP BY ALL")
def accuracy_ci(spark, sf_dir):
    return stats.accuracy_ci(facts(spark), ["scenario", "strategy", "algorithm", "seed_count"])


@query(f"{RECORDS} SELECT strategy, {CORR('H0', 'final_unseeded')} AS pearson FROM records GROUP BY 1")
def pearson_h0(spark, sf_dir):
    return stats.pearson_h0(records(spark))


@query(f"{RECORDS} SELECT strategy, {CORR('rx', 'ry')} AS spearman FROM ranked GROUP BY 1")
def spearman_h0(spark, sf_dir):
    return stats.spearman_h0(records(spark))


PERFECT = "round(avg(CASE WHEN abs(final_unseeded - 1) <= 1e-8 + 1e-5 THEN 1::DOUBLE ELSE 0 END), 9) AS perfect_recovery_rate"


@query(f"{RECORDS} SELECT strategy, {PERFECT} FROM records GROUP BY 1")
def perfect_recovery_rate(spark, sf_dir):
    return stats.perfect_recovery_rate(records(spark))


FIT = "fit AS (SELECT strategy, s AS slope, my - s * mx AS intercept, low, high FROM (SELECT strategy, CASE WHEN stddev_pop(H0) > 1e-8 THEN covar_pop(H0, final_unseeded) / var_pop(H0) END AS s, avg(H0) AS mx, avg(final_unseeded) AS my, min(H0) AS low, max(H0) AS high FROM records GROUP BY 1))"


@query(f"{RECORDS}, {FIT} SELECT strategy, round(slope, 9) AS slope, round(intercept, 9) AS intercept FROM fit")
def h0_linear_fit(spark, sf_dir):
    return stats.linear_fit(records(spark))


@query(f"{RECORDS}, {FIT} SELECT strategy, k, round(low + (high - low) * k / 199::DOUBLE, 6) AS x, round(slope * (low + (high - low) * k / 199::DOUBLE) + intercept, 6) AS y FROM fit, (SELECT unnest(range(200)) AS k) WHERE slope IS NOT NULL")
def h0_fit_line(spark, sf_dir):
    return stats.fit_line(records(spark))


SUMMARY = f"""summary AS (SELECT strategy, count(*) AS n_trials, round(avg(H0), 9) AS mean_H0, round(stddev_pop(H0), 9) AS std_H0, round(avg(final_unseeded), 9) AS mean_final_unseeded, round(stddev_pop(final_unseeded), 9) AS std_final_unseeded,
round(avg(final_all), 9) AS mean_final_all, round(avg(alpha0), 9) AS mean_alpha0, {PERFECT}, {CORR('H0', 'final_unseeded')} AS correlation_H0_final_unseeded, {CORR('rx', 'ry')} AS spearman_H0_final_unseeded FROM ranked GROUP BY 1)"""


@query(f"{RECORDS}, {SUMMARY} SELECT * FROM summary")
def h0_summary(spark, sf_dir):
    return stats.h0_summary(records(spark))


@query(f"{RECORDS}, {SUMMARY} SELECT row_number() OVER (ORDER BY mean_final_unseeded DESC, strategy) AS place, strategy, mean_H0, mean_final_unseeded, mean_final_all, correlation_H0_final_unseeded, spearman_H0_final_unseeded FROM summary")
def strategy_ranking(spark, sf_dir):
    return stats.strategy_ranking(stats.h0_summary(records(spark)))


@query(f"{RECORDS}, {SUMMARY} SELECT strategy, rpad(strategy, 30, ' ') || lpad(format('{{:.4f}}', mean_H0), 10, ' ') || lpad(format('{{:.4f}}', mean_final_unseeded), 10, ' ') || lpad(format('{{:.4f}}', mean_final_all), 10, ' ') AS line FROM summary")
def strategy_report(spark, sf_dir):
    return stats.strategy_report(stats.h0_summary(records(spark)))


@query(f"{FACTS} SELECT scenario, strategy, algorithm, seed_count, array_to_string(list(printf('%.4f', accuracy) ORDER BY trial), ',') AS scores FROM facts GROUP BY ALL")
def grouped_scores(spark, sf_dir):
    g = stats.grouped_scores(facts(spark))
    return g.withColumn("scores", F.array_join(F.transform("scores", lambda x: F.format_string("%.4f", x)), ","))


@query(f"{FACTS} SELECT strategy, {', '.join(f'round(avg(accuracy) FILTER (seed_count = {k}), 9) AS k_{k}' for k in COUNTS)} FROM facts GROUP BY 1")
def results_pivot(spark, sf_dir):
    return stats.results_pivot(facts(spark), "strategy", COUNTS)


@query(f"{FACTS} SELECT scenario, strategy, seed_count, CAST(row_number() OVER (PARTITION BY scenario, strategy, seed_count ORDER BY trial) AS INTEGER) AS trial, accuracy AS value FROM facts")
def results_json(spark, sf_dir):
    """To JSON and back."""
    return sinks.read_results(sinks.results_json(facts(spark)))


GRID = " UNION ALL ".join(f"SELECT '{s.name}' AS scenario, '{s.algorithm}' AS algorithm, {s.strategies} AS strategies, {s.seed_numbers} AS seed_numbers, {s.trials} AS trials" for s in experiments.SCENARIOS)


@query(f"SELECT scenario, strategy, algorithm, seed_count, unnest(range(1, trials + 1)) AS trial FROM (SELECT scenario, algorithm, strategy, unnest(seed_numbers) AS seed_count, trials FROM (SELECT *, unnest(strategies) AS strategy FROM ({GRID})))")
def job_grid(spark, sf_dir):
    return experiments.job_grid(spark)


# Experiments: the published scenarios, graphs, strategies and seed counts. A cell has TRIALS trials here; the
# command line runs the scenarios' own 20 (README, with times).

TRIALS = 1


def scenarios(algorithm: str | None = None, family: str | None = None) -> list[experiments.Scenario]:
    return [replace(s, trials=TRIALS) for s in experiments.SCENARIOS if algorithm in (None, s.algorithm) and family in (None, s.family)]


@query()
def experiment_paired(spark, sf_dir):
    return Runner(scenarios("percolation")).facts(spark).drop("cpu_seconds")


@query()
def experiment_unpaired(spark, sf_dir):
    return Runner(scenarios("percolation"), paired=False).facts(spark).drop("cpu_seconds")


@query()
def experiment_algorithms(spark, sf_dir):
    return Runner(scenarios("percolation", "er"), algorithms=["sgm", "percolation", "percolation_no_expansion"]).facts(spark).drop("cpu_seconds")


@query()
def sweep(spark, sf_dir):
    """All scenarios, with accuracy and CPU time."""
    facts = Runner(scenarios()).facts(spark)
    return stats.accuracy_ci(facts, ["scenario", "strategy", "algorithm", "seed_count"])


@query()
def sgm_match(spark, sf_dir):
    return Runner(scenarios("sgm", "er")).facts(spark).drop("cpu_seconds")


@query()
def h0_records(spark, sf_dir):
    return experiments.paired_er(0.8).records(spark)


@query()
def sgm_history(spark, sf_dir):
    return h0_records(spark, sf_dir).select("strategy", "trial", "alpha0", "step_toward_Q0", "n_iter")


@query()
def first_direction_ratio(spark, sf_dir):
    return h0_records(spark, sf_dir).select("strategy", "trial", "H0")


@query()
def paired_er(spark, sf_dir):
    return stats.h0_summary(experiments.paired_er(0.8).records(spark))


@query()
def paired_sbm(spark, sf_dir):
    return stats.h0_summary(experiments.paired_sbm(0.8).records(spark))
