"""Benchmark decontamination with DataFrame functions only.

Words of texts, A-Z lower-cased, are compared in windows: 10 consecutive words of a benchmark item,
or the whole item if it has fewer. Three steps find each place in a text where a window occurs:

1. A bit table (at most 2**20 bits) of the windows' first words goes to the tasks as a scalar
   subquery. Each place of a text is tested against it, so that few places leave the row.
2. The windows at those places join the set of benchmark windows on the whole window: the join is the
   exact check. The set is broadcast while it has at most BROADCAST_WINDOWS rows, and shuffled beyond.
3. The places of a document meet again by (doc_id, hash of the text): rows are a few numbers.

Documents: a null text has no words and is clean; repeated rows are each reported (and each kept or
removed); a null doc_id is an id like any other. Items without words have no windows. An item with a
null id marks words and counts for no item. Empty tables: nothing is hit. Only doc_id, text, item_id
are read; further columns pass through remove() unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii, table

#: Fixed value of the contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 20  # a row carries the table through the scan, so it is no larger than it need be
HEAD = 3
BROADCAST_WINDOWS = 2_000_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def bench_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, len, win (its words, spaced), head (the hash of its first words); a row for each distinct window of an item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    at = items.select("item_id", "w", n.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    return at.select("item_id", "len", F.array_join(F.slice("w", F.col("i"), F.col("len")), " ").alias("win"), head_hash("w", F.col("i") - 1, F.col("len")).alias("head")).distinct()


def head_hash(w: str, i: Column, length: Column) -> Column:
    """Hash of the first HEAD words of a window (fewer in a shorter one), by its length."""
    at = F.col(w)
    parts = [F.when(length > k, F.get(at, i + k)) for k in range(HEAD)]
    return F.xxhash64(F.least(length, F.lit(HEAD)), *parts)


def table_bits(n_windows: int) -> int:
    """32 bits a window, within bounds: beyond them, more places pass the first step, and the join still decides."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (32 * max(n_windows, 1) - 1).bit_length()))


def bit_table(spark: SparkSession, windows: DataFrame, bits: int) -> Column:
    """bits/64 longs as a scalar subquery."""
    b = F.pmod("head", F.lit(bits))
    have = windows.select(F.floor(b / 64).cast("long").alias("i"), F.expr(f"shiftleft(1L, cast(pmod(head, {bits}) % 64 as int))").alias("v")).groupBy("i").agg(F.bit_or("v").alias("v"))
    full = spark.range(bits // 64).join(have, F.col("id") == F.col("i"), "left").select(F.struct(F.col("id"), F.coalesce("v", F.lit(0).cast("long")).alias("v")).alias("s"))
    return full.agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["v"]).alias("t")).scalar()


def has_bit(bits_table: str, h: Column, bits: int) -> Column:
    b = F.pmod(h, F.lit(bits))
    word = F.get(F.col(bits_table), F.floor(b / 64).cast("int"))
    return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))) != 0


def candidates(n: int, bits: int) -> Column:
    """From columns w and bits: the places at which a window of n words may start, with its words."""
    starts = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
    places = F.filter(starts, lambda i: has_bit("bits", head_hash("w", i, F.lit(n)), bits))
    return F.transform(places, lambda i: F.struct(i.alias("i"), F.lit(n).alias("len"), F.array_join(F.slice("w", i + 1, n), " ").alias("win")))


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th (hash of the text), copies, n_words, spans (array of (start, length), from 0, sorted) and items (sorted)."""
    windows = bench_windows(benchmark, window).cache()
    n_windows = windows.count()
    lengths = sorted(r[0] for r in windows.select("len").distinct().limit(window).collect())
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    marker = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("len"), F.lit("").alias("win")))
    found = [marker]
    if lengths:
        bits = table_bits(n_windows)
        base = base.withColumn("bits", bit_table(spark, windows, bits))
        found += [candidates(n, bits) for n in lengths]
    rows = base.select("doc_id", "th", F.size("w").alias("n_words"), F.explode(F.concat(*found)).alias("c")).select("doc_id", "th", "n_words", "c.*")
    some = windows.select("item_id", "len", "win")
    some = F.broadcast(some) if n_windows <= BROADCAST_WINDOWS else some
    hit = F.col("found") & (F.col("i") >= 0)
    return (
        rows.join(some.withColumn("found", F.lit(True)), ["len", "win"], "left")
        .where(F.coalesce("found", F.lit(False)) | (F.col("i") < 0))
        .groupBy("doc_id", "th", "n_words")
        .agg(
            F.sum((F.col("i") < 0).cast("long")).alias("copies"),
            F.sort_array(F.collect_set(F.when(hit, F.struct("i", "len")))).alias("spans"),
            F.sort_array(F.collect_set(F.when(hit, F.col("item_id")))).alias("items"),
        )
    )


def covered(spans: Column) -> Column:
    """Words inside the union of sorted spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["i"] + s["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["i"] + s["len"] - F.greatest(a["end"], s["i"]))).cast("long").alias("n"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The contract's row for each document, and spans."""
    found = hits(spark, docs, benchmark, window)
    n_hit = covered(F.col("spans"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "spans",
    )


def remove(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, mode: str = "document", window: int = WINDOW) -> DataFrame:
    """docs without its contaminated documents, or ('span') without the words that are hit.

    In 'span' mode a text that is hit becomes its other words, A-Z lower-cased and spaced; clean texts stay as they are.
    """
    if mode not in ("document", "span"):
        raise ValueError(mode)
    found = hits(spark, docs, benchmark, window).where(F.size("spans") > 0).select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), F.col("spans").alias("hit_spans"))
    same = docs["doc_id"].eqNullSafe(found["hit_id"]) & (F.xxhash64(docs["text"]) == found["hit_th"])
    if mode == "document":
        return docs.join(found.select("hit_id", "hit_th"), same, "left_anti")
    inside = lambda i: F.exists(found["hit_spans"], lambda s: (s["i"] <= i) & (i < s["i"] + s["len"]))
    left = F.filter(words(docs["text"]), lambda x, i: ~inside(i))
    text = F.when(found["hit_th"].isNull(), docs["text"]).otherwise(F.array_join(left, " "))
    return docs.join(found, same, "left").select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def oracle() -> str:
    w = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(len(w), {WINDOW}) AS n FROM (SELECT item_id, {w} AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
docs AS (SELECT doc_id, coalesce({w}, []) AS w FROM documents),
places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.i, p.n, s.item_id FROM places p JOIN wins s ON p.n = s.n AND p.win = s.win),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY 1),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
