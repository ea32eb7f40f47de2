import json

import numpy as np
import pytest

from pairloom import sinks
from pairloom.plans import experiments, queries, stats
from pairloom.plans.experiments import Runner, Scenario
from pairloom.streaming.results import running_accuracy

TINY = [Scenario("t", "er", {"n": 40, "p": 0.3, "rho": 0.9}, "percolation", ["random_seeds", "highest_degree_seeds"], [0, 5], 2)]


@pytest.fixture(scope="module")
def facts(spark):
    df = Runner(TINY).facts(spark).cache()
    df.count()
    return df


def test_facts(facts):
    rows = facts.collect()
    assert len(rows) == 8 and all(0 <= r.accuracy <= 1 and r.cpu_seconds >= 0 for r in rows)
    assert all(r.accuracy == 0 for r in rows if r.seed_count == 0)


def test_same_rows_again(spark, facts):
    again = Runner(TINY).facts(spark).drop("cpu_seconds")
    assert again.exceptAll(facts.drop("cpu_seconds")).count() == 0


def test_sweep_files(spark, facts, tmp_path):
    sinks.write_sweep(facts, str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out/accuracy")).first()["value"]
    cells = json.loads(line)
    assert set(cells) == {"random_seeds", "highest_degree_seeds"} and len(cells["random_seeds"]["5"]) == 2
    assert (tmp_path / "out/runtime").exists() and (tmp_path / "out/accuracy_ci").exists()


def test_running_summary(spark, facts, tmp_path):
    facts.write.parquet(str(tmp_path / "in"))
    q = running_accuracy(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("running").count() == 4


def test_undefined_statistics(spark):
    one = spark.createDataFrame([("s", 0.5, 0.7)], "strategy string, H0 double, final_unseeded double")
    assert stats.pearson_h0(one).first()["pearson"] is None and stats.spearman_h0(one).first()["spearman"] is None
    three = spark.createDataFrame([("s", 1.0, 2.0), ("s", 2.0, 3.0), ("s", 3.0, 5.0)], one.schema)
    fit = stats.linear_fit(three).first()
    assert fit["slope"] == pytest.approx(1.5) and fit["intercept"] == pytest.approx(1 / 3, abs=1e-8)
    ties = spark.createDataFrame([("s", 1.0, 2.0), ("s", 1.0, 3.0), ("s", 2.0, 5.0)], one.schema)
    assert sorted(r.rank_H0 for r in stats.with_ranks(ties, ["strategy"], ["H0"]).collect()) == [1.5, 1.5, 3.0]


def test_first_direction_records(spark):
    rows = experiments.paired_er(0.9, n=40, p=0.3, n_seeds=6, trials=2).records(spark).collect()
    assert len(rows) == 12 and all(r.step_toward_Q0 == pytest.approx(1 - r.alpha0) for r in rows)
    all_seeds = experiments.FirstDirection("er", {"n": 10, "p": 0.3, "rho": 0.9}, ["random_seeds"], 10, 1).records(spark).first()
    assert np.isnan(all_seeds.H0) if all_seeds.H0 is not None else True


def test_every_oracle_has_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_console_summary(spark):
    made = stats.h0_summary(queries.records(spark))
    lines = sinks.console_summary(made).splitlines()
    assert len(lines) == 4 and all(line.startswith("strategy ") and len(line) == 60 for line in lines)


def test_queries_run_the_whole_catalogue(spark, monkeypatch):
    runs, studies = [], []

    class Seen(Runner):
        def facts(self, spark):
            runs.append(self)
            return Runner(TINY, self.paired, self.algorithms).facts(spark)

    def records(self, spark):
        studies.append(self)
        return spark.createDataFrame([], experiments.RECORD)

    monkeypatch.setattr(queries, "Runner", Seen)
    monkeypatch.setattr(experiments.FirstDirection, "records", records)
    for name in ("experiment_paired", "experiment_unpaired", "experiment_algorithms", "sweep", "sgm_match", "h0_records", "paired_er", "paired_sbm"):
        queries.QUERIES[name](spark, "")
    names = lambda *algorithms: [s.name for s in experiments.SCENARIOS if s.algorithm in algorithms]
    er = lambda algorithm: [n for n in names(algorithm) if " er," in n]
    met = [[s.name for s in r.scenarios] for r in runs]
    assert met == [names("percolation")] * 2 + [er("percolation"), names("sgm", "percolation"), er("sgm")]
    published = {s.name: (s.params, s.strategies, s.seed_numbers) for s in experiments.SCENARIOS}
    assert all((s.params, s.strategies, s.seed_numbers) == published[s.name] for r in runs for s in r.scenarios)
    assert [(s.n_seeds, s.trials) for s in studies] == [(20, 100)] * 3
    assert [s.params.get("n", 3 * s.params.get("n_per_block", 0)) for s in studies] == [300] * 3
