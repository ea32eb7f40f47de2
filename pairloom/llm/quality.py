"""Quality classifier: a sparse rule ensemble compiled into column expressions.

1. STATISTICS are columns over a text (word and line repetition, symbols, capitals, lengths), built from
   DataFrame functions only.
2. On at most FIT_ROWS labelled rows (as many of each label, those of least hash of doc_id and text),
   boosted shallow trees are grown over the statistics; each path from a root to a node is a rule: a
   conjunction of comparisons.
3. A logistic model with an L1 penalty over the rules and the scaled statistics keeps few of them.
4. The kept rules become one column expression, which scores all documents in the scan.

Null and empty texts have all statistics 0 and are scored like other texts. If the labelled rows hold
fewer than two labels, the score is the label's rate (0.5 without rows). Repeated rows are scored alike.
A doc_id with several texts or labels brings all of them to the fit, within its bound. Empty table: no
rows. Only text is an input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, crc_mod, small_batches, table, thinned

FIT_ROWS = 4000
TREES, DEPTH, LEAF, SHRINK, BINS = 30, 3, 12, 0.3, 32
L1, LASSO_STEPS = 2e-3, 600
CUT = 0.3

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most, bound), all of them


def statistics() -> dict[str, Column]:
    """Over columns t (the text) and w (its words) that with_statistics() makes."""
    chars = F.greatest(F.length("t"), F.lit(1))
    n_words = F.greatest(F.size("w"), F.lit(1))
    left = lambda pattern: F.length(F.regexp_replace("t", pattern, "")) / chars
    return {
        "log_words": F.log1p(F.size("w").cast("double")),
        "distinct_words": F.size("d") / n_words,
        "word_length": chars / n_words,
        "letters": 1 - left(r"\p{L}+"),
        "capitals": 1 - left(r"\p{Lu}+"),
        "digits": 1 - left(r"[0-9]+"),
        "marks": 1 - left(r"[^\p{L}\p{N}\s.,]+"),
        "stops": 1 - left(r"[.,]"),
        "bars": (F.length("t") - F.length(F.replace("t", F.lit("|"), F.lit("")))) / chars,
        "shouts": (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))) / chars,
        "same_as_before": (F.size("w") - F.size("c")) / n_words,
        "distinct_lines": F.size(F.array_distinct("l")) / F.greatest(F.size("l"), F.lit(1)),
        "log_lines": F.log1p(F.size("l").cast("double")),
    }


def with_statistics(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with a column s (struct of statistics), and their names."""
    base = docs.withColumn("t", F.coalesce(F.col("text"), F.lit("")))
    base = base.withColumn("w", F.filter(F.split("t", r"\s+"), lambda x: x != "")).withColumn("l", F.split("t", "\n"))
    base = base.withColumn("d", F.array_distinct("w")).withColumn("c", F.filter("w", lambda x, i: (i == 0) | (x != F.get("w", i - 1))))
    cols = statistics()
    return base.withColumn("s", F.struct(*[F.coalesce(c, F.lit(0.0)).cast("double").alias(n) for n, c in cols.items()])).drop("t", "w", "l", "d", "c"), list(cols)


@dataclass
class Tree:
    """A regression tree on binned statistics, grown for the gradient g with curvature h."""

    rules: list[Rule] = field(default_factory=list)

    def grow(self, x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], names: list[str], g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: Rule, out: np.ndarray) -> None:
        if path:
            self.rules.append(path)
        best = None
        total, mass = g[rows].sum(), h[rows].sum()
        if len(path) < DEPTH and len(rows) >= 2 * LEAF:
            for f in range(x.shape[1]):
                n = len(edges[f]) + 1
                b = bins[rows, f]
                gs, hs, cs = (np.cumsum(np.bincount(b, v, n))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                ok = (cs >= LEAF) & (len(rows) - cs >= LEAF)
                if not ok.any():
                    continue
                gain = np.where(ok, gs**2 / (hs + 1) + (total - gs) ** 2 / (mass - hs + 1) - total**2 / (mass + 1), -1)
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, k)
        if best is None:
            out[rows] = total / (mass + 1)
            return
        _, f, k = best
        low = bins[rows, f] <= k
        bound = float(edges[f][k])
        for part, below in ((rows[low], True), (rows[~low], False)):
            self.grow(x, bins, edges, names, g, h, part, (*path, (names[f], below, bound)), out)


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Rule]:
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree, out = Tree(), np.zeros(len(y))
        tree.grow(x, bins, edges, names, y - p, p * (1 - p), np.arange(len(y)), (), out)
        rules.update(dict.fromkeys(tuple(sorted(r)) for r in tree.rules))
        margin += SHRINK * out
    return list(rules)


def holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, below, bound in rule:
        v = x[:, names.index(name)]
        out &= v <= bound if below else v > bound
    return out


def lasso(z: np.ndarray, y: np.ndarray, l1: float = L1, steps: int = LASSO_STEPS) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the logistic loss; the constant is free."""
    n, m = z.shape
    a = np.hstack([z, np.ones((n, 1))])
    step = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -30, 30))) - y) / n
        new = v - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[Rule, float]]
    linear: list[tuple[str, float, float, float]]  # statistic, weight, least, most

    def column(self, s: str = "s") -> Column:
        """The score as an expression over the struct of statistics."""
        parts = [F.lit(self.bias)]
        for rule, w in self.rules:
            every = F.lit(True)
            for name, below, bound in rule:
                c = F.col(s)[name]
                every = every & (c <= bound if below else c > bound)
            parts.append(F.when(every, w).otherwise(0.0))
        for name, w, low, high in self.linear:
            parts.append(w * F.least(F.greatest(F.col(s)[name], F.lit(low)), F.lit(high)))
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, w in self.rules:
            total += w * holds(rule, x, names)
        for name, w, low, high in self.linear:
            total += w * np.clip(x[:, names.index(name)], low, high)
        return 1 / (1 + np.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> Ensemble:
    if len(np.unique(y)) < 2:
        rate = float(y.mean()) if len(y) else 0.5
        return Ensemble(float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), [], [])
    rules = tree_rules(x, y, names)
    fired = np.stack([holds(r, x, names) for r in rules], 1).astype(float) if rules else np.zeros((len(x), 0))
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, low, high)
    sd = clipped.std(0)
    scale = np.where(sd > 1e-9, 0.4 / np.maximum(sd, 1e-9), 0)
    mean = clipped.mean(0)
    share = fired.mean(0)
    w, b = lasso(np.hstack([fired - share, (clipped - mean) * scale]), y)
    wr, wl = w[: len(rules)], w[len(rules) :] * scale
    b -= float(share @ wr + mean @ wl)
    return Ensemble(b, [(r, float(v)) for r, v in zip(rules, wr, strict=True) if abs(v) > 1e-6], [(n, float(v), float(lo), float(hi)) for n, v, lo, hi in zip(names, wl, low, high, strict=True) if abs(v) > 1e-6])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Ensemble:
    """labels: doc_id, quality 0 or 1, already without held-out rows."""
    small_batches(docs.sparkSession)
    own = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").distinct()
    some, each = thinned(own, "quality", rows, F.col("doc_id"))
    found = bounded(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "quality", each)
    stats, names = with_statistics(found)
    got = stats.select("quality", "s.*").toPandas().sort_values(["quality", *names])
    return fit_rules(got[names].to_numpy(float), got["quality"].to_numpy(float), names)


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """docs' doc_id, score."""
    stats, _ = with_statistics(docs.select("doc_id", "text"))
    return stats.select("doc_id", model.column().alias("score"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    out = score(docs, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
