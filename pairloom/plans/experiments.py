"""Experiments: grids of trials, each run in a task of its own.

The generator of random numbers comes from the trial's key, so a trial gives the same rows whatever
task, order or retry it runs in. Paired experiments use one graph pair for all strategies of a trial.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.model import FACT, RECORD

RANDOM, BLOCKED = "random_seeds", "blocked_random_seeds"
DEGREE, NEIGHBORS = "highest_degree_seeds", "neighbor_degree_seeds"
BETWEEN, TRIANGLES = "betweenness_seeds", "triangle_degree_ratio_seeds"


@dataclass
class Scenario:
    name: str
    family: str
    params: dict
    algorithm: str
    strategies: list[str]
    seed_numbers: list[int]
    trials: int = 20
    block_probs: list[list[float]] | None = None

    def kwargs(self) -> dict:
        out = {k: int(v) if k.startswith("n") else v for k, v in self.params.items()}
        return out | ({"block_probs": self.block_probs} if self.block_probs else {})


#: The published scenarios.
P1 = [[0.7, 0.3, 0.4], [0.3, 0.7, 0.3], [0.4, 0.3, 0.7]]
P2 = [[0.02, 0.005, 0.01], [0.005, 0.02, 0.005], [0.01, 0.005, 0.02]]
LONG = [2, 4, 6, 8, 10, 15, 22, 30, 50]
DENSE_SBM, SPARSE_SBM = {"n_per_block": 200, "n_blocks": 3, "rho": 0.5}, {"n_per_block": 200, "n_blocks": 3, "rho": 0.8}
HEAVY, LIGHT = {"n": 600, "alpha": 2.0, "p": 0.005, "rho": 0.7}, {"n": 600, "alpha": 3.0, "p": 0.005, "rho": 0.7}
DENSE, SPARSE = {"n": 600, "p": 0.2, "rho": 0.5}, {"n": 600, "p": 0.01, "rho": 0.5}
SCENARIOS = [
    Scenario("dense sbm, sgm", "sbm", DENSE_SBM, "sgm", [RANDOM, BETWEEN, TRIANGLES, BLOCKED, NEIGHBORS], [2, 4, 5, 6, 8, 10], block_probs=P1),
    Scenario("heavy paper, percolation", "paper", HEAVY, "percolation", [RANDOM, BETWEEN, TRIANGLES, DEGREE, NEIGHBORS], LONG),
    Scenario("heavy paper, sgm", "paper", HEAVY, "sgm", [RANDOM, BETWEEN, TRIANGLES, DEGREE, NEIGHBORS], LONG),
    Scenario("light paper, percolation", "paper", LIGHT, "percolation", [RANDOM, BETWEEN, TRIANGLES, DEGREE, NEIGHBORS], LONG),
    Scenario("light paper, sgm", "paper", LIGHT, "sgm", [RANDOM, BETWEEN, TRIANGLES, DEGREE, NEIGHBORS], [*LONG, 80]),
    Scenario("sparse sbm, percolation", "sbm", SPARSE_SBM, "percolation", [RANDOM, BETWEEN, TRIANGLES, BLOCKED, NEIGHBORS], [0, 2, 4, 6, 8, 10, 15], block_probs=P2),
    Scenario("sparse sbm, sgm", "sbm", SPARSE_SBM, "sgm", [RANDOM, BETWEEN, TRIANGLES, BLOCKED, NEIGHBORS], [2, 4, 6, 8, 10, 15, 20, 25], block_probs=P2),
    Scenario("sparse er, sgm", "er", SPARSE, "sgm", [RANDOM, BETWEEN, TRIANGLES, DEGREE], [0, 10, 30, 50, 100, 150]),
    Scenario("sparse er, percolation", "er", SPARSE, "percolation", [RANDOM, BETWEEN, TRIANGLES, DEGREE], [0, 10, 30, 50, 100, 150]),
    Scenario("dense er, sgm", "er", DENSE, "sgm", [RANDOM, BETWEEN, TRIANGLES, DEGREE], [2, 4, 6, 8, 10, 15, 30]),
    Scenario("dense er, percolation", "er", DENSE, "percolation", [RANDOM, BETWEEN, TRIANGLES, DEGREE], [2, 4, 6, 8, 10, 15, 30]),
    Scenario("dense sbm, percolation", "sbm", DENSE_SBM, "percolation", [RANDOM, BETWEEN, TRIANGLES, BLOCKED, NEIGHBORS], [2, 4, 6, 8, 10, 15, 30, 50], block_probs=P1),
]
CATALOG = "name string, family string, params map<string,double>, block_probs array<array<double>>, strategies array<string>, algorithm string, seed_numbers array<int>, trials int"


def catalog(spark: SparkSession, scenarios: list[Scenario] = SCENARIOS) -> DataFrame:
    rows = [(s.name, s.family, {k: float(v) for k, v in s.params.items()}, s.block_probs, s.strategies, s.algorithm, s.seed_numbers, s.trials) for s in scenarios]
    return spark.createDataFrame(rows, CATALOG)


def job_grid(spark: SparkSession, scenarios: list[Scenario] = SCENARIOS) -> DataFrame:
    """scenario, strategy, algorithm, seed_count, trial (from 1): a row a job."""
    one = catalog(spark, scenarios).select(F.col("name").alias("scenario"), "algorithm", F.explode("strategies").alias("strategy"), "seed_numbers", "trials")
    two = one.select("scenario", "strategy", "algorithm", F.explode("seed_numbers").alias("seed_count"), "trials")
    return two.select("scenario", "strategy", "algorithm", "seed_count", F.explode(F.sequence(F.lit(1), F.col("trials"))).alias("trial"))


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


@dataclass
class Runner:
    """Runs jobs of scenarios in tasks. paired: the strategies (and algorithms) of a trial share a graph pair and its seeds."""

    scenarios: list[Scenario]
    paired: bool = True
    algorithms: list[str] | None = None  # instead of the scenario's own
    seed: int = 1234
    by_name: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.by_name = {s.name: s for s in self.scenarios}

    def trial(self, scenario: str, seed_count: int, trial: int, strategies: list[str]) -> Iterator[dict]:
        import time
        import zlib

        import numpy as np

        from pairloom import registry

        s = self.by_name[scenario]

        def rng(*more: str):
            return np.random.default_rng([self.seed, zlib.crc32(scenario.encode()), seed_count, trial, *[zlib.crc32(m.encode()) for m in more]])

        shared = registry.GENERATORS[s.family](rng("graphs"), **s.kwargs()) if self.paired else None
        blocks = {"n_blocks": int(s.params["n_blocks"])} if "n_blocks" in s.params else {}
        for strategy in strategies:
            for algorithm in self.algorithms or [s.algorithm]:
                a, b, truth = shared or registry.GENERATORS[s.family](rng("graphs", strategy, algorithm), **s.kwargs())
                chosen = np.asarray(registry.STRATEGIES[strategy](a, seed_count, rng("seeds", strategy), **blocks), int)
                seeds = np.stack([chosen, truth[chosen]], 1)
                began = time.process_time()
                found = registry.ALGORITHMS[algorithm](a, b, seeds)
                took = time.process_time() - began
                yield {"scenario": scenario, "strategy": strategy, "algorithm": algorithm, "seed_count": seed_count, "trial": trial, "accuracy": float((found == truth).mean()), "cpu_seconds": took}

    def facts(self, spark: SparkSession) -> DataFrame:
        """The fact table: a row a job."""
        grid = job_grid(spark, self.scenarios)
        keys = ["scenario", "seed_count", "trial"] if self.paired else ["scenario", "seed_count", "trial", "strategy"]
        jobs = grid.groupBy(*keys).agg(F.sort_array(F.collect_list("strategy")).alias("strategies"))
        run = self.trial

        def work(batches: Iterator) -> Iterator:
            import pandas as pd

            for batch in batches:
                for job in batch.itertuples():
                    yield pd.DataFrame(list(run(job.scenario, int(job.seed_count), int(job.trial), list(job.strategies))))

        # a trial takes seconds: many small partitions keep all cores at work
        return jobs.select("scenario", "seed_count", "trial", "strategies").repartition(4 * cores(spark), *[k for k in keys if k != "strategy"]).mapInPandas(work, FACT)


@dataclass
class FirstDirection:
    """How far the first direction of seeded matching already points at the truth: records of trials."""

    family: str
    params: dict
    strategies: list[str]
    n_seeds: int = 20
    trials: int = 100
    seed: int = 1234

    def trial(self, trial: int) -> Iterator[dict]:
        import numpy as np

        from pairloom import registry
        from pairloom.kernels import matching

        a, b, truth = registry.GENERATORS[self.family](np.random.default_rng([self.seed, trial]), **self.params)
        blocks = {"n_blocks": self.params["n_blocks"]} if "n_blocks" in self.params else {}
        for k, strategy in enumerate(self.strategies):
            chosen = np.asarray(registry.STRATEGIES[strategy](a, self.n_seeds, np.random.default_rng([self.seed, trial, k]), **blocks), int)
            seeds = np.stack([chosen, truth[chosen]], 1)
            found, history = matching.seeded_match(a, b, seeds)
            rest = np.setdiff1d(np.arange(len(a)), chosen)
            alpha = history.alphas[0] if history.alphas else None
            yield {
                "strategy": strategy,
                "trial": trial,
                "H0": matching.first_direction_accuracy(history, len(a), seeds, truth),
                "final_unseeded": float((found[rest] == truth[rest]).mean()) if len(rest) else None,
                "final_all": float((found == truth).mean()),
                "alpha0": alpha,
                "step_toward_Q0": None if alpha is None else 1 - alpha,
                "n_iter": len(history.alphas),
            }

    def records(self, spark: SparkSession) -> DataFrame:
        run = self.trial

        def work(batches: Iterator) -> Iterator:
            import pandas as pd

            for batch in batches:
                for t in batch["id"]:
                    yield pd.DataFrame(list(run(int(t))))

        return spark.range(1, self.trials + 1).repartition(min(self.trials, 4 * cores(spark)), "id").mapInPandas(work, RECORD)


ER_STRATEGIES = [RANDOM, DEGREE, BETWEEN, TRIANGLES, NEIGHBORS, "jaccard_neighborhood_seeds"]
SBM_STRATEGIES = [*ER_STRATEGIES, BLOCKED, "blocked_highest_degree_seeds"]
SBM_PROBS = ((0.3, 0.1, 0.1), (0.1, 0.3, 0.1), (0.1, 0.1, 0.3))


def paired_er(rho: float, n: int = 300, p: float = 0.2, n_seeds: int = 20, trials: int = 100) -> FirstDirection:
    return FirstDirection("er", {"n": n, "p": p, "rho": rho}, ER_STRATEGIES, n_seeds, trials)


def paired_sbm(rho: float, n_per_block: int = 100, n_blocks: int = 3, probs=SBM_PROBS, n_seeds: int = 20, trials: int = 100) -> FirstDirection:
    return FirstDirection("sbm", {"n_per_block": n_per_block, "n_blocks": n_blocks, "rho": rho, "block_probs": probs}, SBM_STRATEGIES, n_seeds, trials)
