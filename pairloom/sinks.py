"""Results to files: a Parquet fact table by scenario, one JSON object a scenario and measure, and plot data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.plans import stats

NESTED = "map<string,map<string,array<double>>>"


def results_json(facts: DataFrame, value: str = "accuracy", label: str = "strategy") -> DataFrame:
    """scenario, json: {label: {"seed count": [values by trial]}}."""
    cells = facts.groupBy("scenario", label, "seed_count").agg(F.transform(F.sort_array(F.collect_list(F.struct("trial", value))), lambda s: s[value]).alias("values"))
    counts = cells.groupBy("scenario", label).agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("seed_count", "values"))), lambda s: F.struct(s["seed_count"].cast("string").alias("k"), s["values"].alias("v")))).alias("m"))
    whole = counts.groupBy("scenario").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(label).alias("k"), F.to_json("m").alias("v"))))).alias("m"))
    parts = F.transform(F.map_entries("m"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return whole.select("scenario", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("json"))


def read_results(df: DataFrame) -> DataFrame:
    """scenario, json back to rows: scenario, strategy, seed_count, trial (from 1), value."""
    one = df.select("scenario", F.explode(F.from_json("json", NESTED)).alias("strategy", "cells"))
    two = one.select("scenario", "strategy", F.explode("cells").alias("seed_count", "values"))
    return two.select("scenario", "strategy", F.col("seed_count").cast("int").alias("seed_count"), F.posexplode("values").alias("t", "value")).select("scenario", "strategy", "seed_count", (F.col("t") + 1).alias("trial"), "value")


def write_sweep(facts: DataFrame, to: str) -> None:
    """to/facts (Parquet by scenario), and to/accuracy, to/runtime (a JSON line a scenario), to/accuracy_ci, to/runtime_ci (plot data)."""
    facts.write.partitionBy("scenario").mode("overwrite").parquet(f"{to}/facts")
    facts = facts.sparkSession.read.parquet(f"{to}/facts")
    for value, name in (("accuracy", "accuracy"), ("cpu_seconds", "runtime")):
        results_json(facts, value).write.partitionBy("scenario").mode("overwrite").text(f"{to}/{name}")
        stats.accuracy_ci(facts, ["scenario", "strategy", "algorithm", "seed_count"], value).write.mode("overwrite").parquet(f"{to}/{name}_ci")


def plot_intervals(ci: DataFrame, to: str, label: str = "strategy") -> None:
    """A line and a band a label, drawn on the driver from a summary (a row a label and seed count). Needs matplotlib."""
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    fig, ax = plt.subplots(figsize=(10, 6))
    for name, part in ci.toPandas().sort_values("seed_count").groupby(label):
        ax.plot(part["seed_count"], part["mean"], marker="o", label=name)
        ax.fill_between(part["seed_count"], part["low"], part["high"], alpha=0.2)
    ax.set_xlabel("seeds")
    ax.legend()
    fig.savefig(to)
    plt.close(fig)


def plot_first_direction(records: DataFrame, folder: str) -> list[str]:
    """A scatter of final_unseeded over H0 with the fitted line for each strategy, drawn on the driver from trial records. Needs matplotlib."""
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    lines = {r["strategy"]: r for r in stats.linear_fit(records).join(stats.pearson_h0(records), "strategy").collect()}
    ends = records.groupBy("strategy").agg(F.min("H0").alias("low"), F.max("H0").alias("high")).collect()
    out = []
    for e in ends:
        line = lines[e["strategy"]]
        points = records.where(F.col("strategy") == e["strategy"]).select("H0", "final_unseeded").toPandas()
        fig, ax = plt.subplots()
        ax.scatter(points["H0"], points["final_unseeded"])
        if line["slope"] is not None:
            ax.plot([e["low"], e["high"]], [line["slope"] * x + line["intercept"] for x in (e["low"], e["high"])])
        known = "undefined" if line["pearson"] is None else f"{line['pearson']:.4f}"
        ax.set_title(f"{e['strategy']}, correlation {known}")
        out.append(f"{folder}/{e['strategy']}.png")
        fig.savefig(out[-1])
        plt.close(fig)
    return out


def console_summary(summary: DataFrame) -> str:
    """strategy_report() as text."""
    return "\n".join(r["line"] for r in stats.strategy_report(summary).orderBy("strategy").collect())
