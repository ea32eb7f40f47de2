"""Summaries of experiments. What is undefined (a correlation of constants, an interval of one value) is null or 0 as stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The normal interval, and when numbers count as equal.
Z, ABS, REL, FLAT = 1.96, 1e-8, 1e-5, 1e-8
DIGITS = 9


def is_close(x: Column, y: Column) -> Column:
    return F.abs(x - y) <= ABS + REL * F.abs(y)


def standard_error(x: Column) -> Column:
    """0 for a single value."""
    return F.coalesce(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Null if either is constant or there are fewer than two pairs."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when((sx > FLAT) & (sy > FLAT), sx * sy)


def accuracy_ci(facts: DataFrame, by: list[str], value: str = "accuracy") -> DataFrame:
    """by, n, mean, std, sem, low, high."""
    x = F.col(value)
    out = facts.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), standard_error(x).alias("sem"))
    r = lambda c: F.round(c, DIGITS)
    return out.select(*by, "n", r("mean").alias("mean"), r("std").alias("std"), r("sem").alias("sem"), r(F.col("mean") - Z * F.col("sem")).alias("low"), r(F.col("mean") + Z * F.col("sem")).alias("high"))


def with_ranks(records: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """records with rank_<column>: average ranks within by."""
    for c in columns:
        over, same = Window.partitionBy(*by).orderBy(c), Window.partitionBy(*by, c)
        records = records.withColumn(f"rank_{c}", F.rank().over(over) + (F.count(F.lit(1)).over(same) - 1) / 2.0)
    return records


def pearson_h0(records: DataFrame) -> DataFrame:
    return records.groupBy("strategy").agg(F.round(pearson(F.col("H0"), F.col("final_unseeded")), DIGITS).alias("pearson"))


def spearman_h0(records: DataFrame) -> DataFrame:
    ranked = with_ranks(records, ["strategy"], ["H0", "final_unseeded"])
    return ranked.groupBy("strategy").agg(F.round(pearson(F.col("rank_H0"), F.col("rank_final_unseeded")), DIGITS).alias("spearman"))


def perfect_recovery_rate(records: DataFrame) -> DataFrame:
    perfect = F.when(is_close(F.col("final_unseeded"), F.lit(1.0)), 1.0).otherwise(0.0)
    return records.groupBy("strategy").agg(F.round(F.avg(perfect), DIGITS).alias("perfect_recovery_rate"))


def linear_fit(records: DataFrame) -> DataFrame:
    """strategy, slope, intercept of final_unseeded on H0; null if H0 is constant."""
    x, y = F.col("H0"), F.col("final_unseeded")
    m = records.groupBy("strategy").agg(F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("v"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    slope = F.col("c") / F.when(F.sqrt("v") > FLAT, F.col("v"))
    return m.select("strategy", F.round(slope, DIGITS).alias("slope"), F.round(F.col("my") - slope * F.col("mx"), DIGITS).alias("intercept"))


def fit_line(records: DataFrame, points: int = 200) -> DataFrame:
    """strategy, k, x, y: points from the least to the largest H0 on the fitted line."""
    ends = records.groupBy("strategy").agg(F.min("H0").alias("low"), F.max("H0").alias("high"))
    at = ends.join(linear_fit(records).where("slope is not null"), "strategy").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("low") + (F.col("high") - F.col("low")) * F.col("k") / float(points - 1)
    return at.select("strategy", F.col("k").cast("bigint").alias("k"), F.round(x, 6).alias("x"), F.round(F.col("slope") * x + F.col("intercept"), 6).alias("y"))


def h0_summary(records: DataFrame) -> DataFrame:
    """A row a strategy: means, deviations, recovery rate and correlations."""
    ranked = with_ranks(records, ["strategy"], ["H0", "final_unseeded"])
    r = lambda c, name: F.round(c, DIGITS).alias(name)
    perfect = F.when(is_close(F.col("final_unseeded"), F.lit(1.0)), 1.0).otherwise(0.0)
    return ranked.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_trials"),
        r(F.avg("H0"), "mean_H0"),
        r(F.stddev_pop("H0"), "std_H0"),
        r(F.avg("final_unseeded"), "mean_final_unseeded"),
        r(F.stddev_pop("final_unseeded"), "std_final_unseeded"),
        r(F.avg("final_all"), "mean_final_all"),
        r(F.avg("alpha0"), "mean_alpha0"),
        r(F.avg(perfect), "perfect_recovery_rate"),
        r(pearson(F.col("H0"), F.col("final_unseeded")), "correlation_H0_final_unseeded"),
        r(pearson(F.col("rank_H0"), F.col("rank_final_unseeded")), "spearman_H0_final_unseeded"),
    )


def strategy_ranking(summary: DataFrame) -> DataFrame:
    """place, strategy and the compared columns, best mean_final_unseeded first."""
    over = Window.orderBy(F.desc("mean_final_unseeded"), "strategy")  # a row a strategy
    return summary.select(F.row_number().over(over).cast("bigint").alias("place"), "strategy", "mean_H0", "mean_final_unseeded", "mean_final_all", "correlation_H0_final_unseeded", "spearman_H0_final_unseeded")


def strategy_report(summary: DataFrame) -> DataFrame:
    """strategy, line: fixed-width text."""
    number = lambda c: F.lpad(F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("undefined")), 10, " ")
    return summary.select("strategy", F.concat(F.rpad("strategy", 30, " "), number("mean_H0"), number("mean_final_unseeded"), number("mean_final_all")).alias("line"))


def grouped_scores(facts: DataFrame) -> DataFrame:
    """scenario, strategy, algorithm, seed_count, scores: by trial."""
    by = ["scenario", "strategy", "algorithm", "seed_count"]
    scores = F.transform(F.sort_array(F.collect_list(F.struct("trial", "accuracy"))), lambda s: s["accuracy"])
    return facts.groupBy(*by).agg(scores.alias("scores"))


def results_pivot(facts: DataFrame, label: str, seed_counts: list[int]) -> DataFrame:
    """label, and a column k_<seed count> of mean accuracies for each seed count."""
    means = facts.groupBy(label).pivot("seed_count", seed_counts).agg(F.round(F.avg("accuracy"), DIGITS))
    return means.select(label, *[F.col(f"`{k}`").alias(f"k_{k}") for k in seed_counts])
