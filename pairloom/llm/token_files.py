"""Token ids in ORC files.

Documents are dealt into ranges of doc_id, sorted in each, encoded, and written by Spark's ORC writer:
integers are run-length encoded, stripes keep row indexes (smallest and largest doc_id each STRIDE rows)
and Bloom filters on doc_id, so that readers take stripes in parallel and skip those without the ids
they look for. A file holds, per document, part (its range's number), local_start (the ids before it in
the range) and its ids with the end id. Ranges ascend, so the ids before a range are the sum of the
earlier ranges' totals, a number for each task that wrote.

A null text is empty (the end id alone). Null doc_ids come first. Documents with equal ids follow each
other in the order of their texts' hashes, and equal rows stay, in any order. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, slices, small_batches, table
from .tokens import ENCODE_BYTES, ENCODE_ROWS, vocabulary_path, word_ids

END_ID = 1
STRIDE = 1000
STRIPE_BYTES = 32 << 20


def write(docs: DataFrame, to: str, path: str, end_id: int = END_ID) -> None:
    """Encodes docs (doc_id, text) by the vocabulary file at path into ORC files in to."""

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, before, words = TaskContext.get().partitionId(), 0, word_ids(path)
        for whole in batches:
            for batch in slices(whole, "text", ENCODE_BYTES):
                ids, ends = words.encode(batch.column("text"))
                n = len(ends) - 1
                more = np.insert(ids, ends[1:], end_id)
                at = ends + np.arange(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), batch.column("doc_id"), pa.array(before + at[:-1]), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(more.astype(np.int32)))],
                    names=["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                before += int(at[-1])
        give_back()

    ranges = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    (
        ranges.mapInArrow(encode, "part int, doc_id long, local_start long, n_tokens long, ids array<int>")
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .orc(to)
    )


def read(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start (the ids of all documents before it), n_tokens, ids. A filter on doc_id reaches the files' indexes."""
    files = spark.read.schema("part int, doc_id long, local_start long, n_tokens long, ids array<int>").orc(at)
    totals = files.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))
    return files.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")  # a row for each task that wrote


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what read() returns, counted from the ids themselves."""

    def crc(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("ids")
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, ENCODE_ROWS)
    to = Scratch(spark, "tokens").path("orc")
    write(table(spark, sf_dir, "documents"), to, vocabulary_path())
    return digests(read(spark, to))
