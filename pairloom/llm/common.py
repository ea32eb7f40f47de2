"""What the operators share: tables, scratch folders, ASCII case, splits of labelled rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pairloom.session import give_back, shared_folder, ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows in an Arrow batch. Texts can be long, so the default of 10,000 would make batches of a GB.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lower_ascii(col: Column) -> Column:
    """A-Z only, so that every engine agrees."""
    return F.translate(col, UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


class Scratch:
    """Tables in the folder that all executors share (spark.checkpoint.dir).

    A written table cuts the lineage: a lost executor costs the tasks it ran, not the stages before. What a
    result is still read from stays until the application ends, which deletes the folder.

    rest: after each so many tables the driver collects its garbage (those of plans, events and shuffles of
    tables written before), else its heap grows to its limit, however little of it is in use.
    """

    def __init__(self, spark: SparkSession, what: str, rest: int = 0):
        self.spark, self.rest = spark, rest
        self.root = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
        self.n, self.kept = 0, []
        fs, at = self.place(self.root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def place(self, to: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(to)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Writes df as Parquet and reads it back."""
        to = self.path(name)
        df.write.options(**options).parquet(to)
        out = self.spark.read.schema(df.schema).parquet(to)
        out.scratch_path = to  # type: ignore[attr-defined]
        self.kept.append(out)
        if self.rest and self.n % self.rest == 0:
            rest_driver(self.spark)
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Deletes a kept table that nothing will read again."""
        to = getattr(df, "scratch_path", None)
        if to:
            self.kept = [x for x in self.kept if x.scratch_path != to]
            self.delete(to)

    def drop_but(self, *needed: DataFrame | None) -> None:
        """Deletes all kept tables but those that a result is read from."""
        stay = {getattr(x, "scratch_path", None) for x in needed}
        for df in [x for x in self.kept if x.scratch_path not in stay]:
            self.drop(df)

    def delete(self, to: str) -> None:
        fs, at = self.place(to)
        fs.delete(at, True)


def rarity(key: Column) -> Column:
    """Leading zeros of a hash of key, from 0 to 62: one key in 2**j has j or more."""
    return 63 - F.length(F.bin(F.xxhash64(key).bitwiseAND(F.lit((1 << 63) - 1))))


def thinned(rows: DataFrame, by: str, total: int, key: Column) -> tuple[DataFrame, int]:
    """rows of few keys, chosen by rarity(), and each: total over the number of values of by.

    Of each value (of the total commonest) at least each rows are there if it has them, and less than some
    2 * each unless keys repeat; bounded() cuts those.
    """
    met = rows.where(F.col(by).isNotNull()).groupBy(by, rarity(key).alias("zeros")).count()
    values = met.groupBy(by).agg(F.sum("count").alias("n"), F.collect_list(F.struct("zeros", "count")).alias("parts"))
    found = values.orderBy(F.desc("n"), by).limit(total).collect()
    each, cuts = total // max(1, len(found)), []
    for r in found:
        count, left, cut = dict(map(tuple, r["parts"])), 0, 0
        for zeros in range(62, -1, -1):
            left += count.get(zeros, 0)
            if left >= each:
                cut = zeros
                break
        cuts.append((r[by], cut))
    least = rows.sparkSession.createDataFrame(cuts, StructType([rows.schema[by], StructField("cut", IntegerType())]))
    return rows.join(F.broadcast(least), by).where(rarity(key) >= F.col("cut")).select(*rows.columns), each


def bounded(rows: DataFrame, by: str, each: int, parts: int = 32) -> DataFrame:
    """Of each value of by, the each rows of least hash of doc_id and text, whatever ids or texts repeat.

    A task keeps its own each, then each part of what tasks kept, so that the last step sorts
    parts * each rows of a value at most.
    """

    def least(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def best(t):
            codes = t[by].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((t["h"].to_numpy(), codes))
            first = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
            return t.take(pa.array(np.sort(order[rank < each])))

        held, most = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows > most:
                held = best(held)
                most = 2 * held.num_rows + BATCH_ROWS
        if held is not None:
            yield from best(held).to_batches()

    hashed = rows.where(F.col(by).isNotNull()).withColumn("h", F.xxhash64("doc_id", "text"))
    some = hashed.mapInArrow(least, hashed.schema).repartition(parts).mapInArrow(least, hashed.schema)
    place = F.row_number().over(Window.partitionBy(by).orderBy("h"))
    return some.withColumn("place", place).where(F.col("place") <= each).drop("h", "place")


def fold_by(rows: DataFrame, key: str, fold: Callable, fan: int = 32) -> DataFrame:
    """One row for each key, folded up a tree: a task holds the rows of fan tasks at most.

    rows: key, task (the number of the task that made the row, once for a key) and values, in a written
    table. fold: an Arrow table of a key's rows to one row of the same columns; the order must not matter.
    """
    top = rows.agg(F.max("task")).first()[0] or 0
    while True:
        rows = rows.withColumn("task", F.floor(F.col("task") / fan).cast("bigint")).groupBy(key, "task").applyInArrow(fold, rows.schema)
        if top < fan:
            return rows
        top //= fan


def rest_driver(spark: SparkSession) -> None:
    """Lets the driver collect its garbage, in the JVM and in Python, and return what it has freed to the system."""
    spark._jvm.System.gc()
    give_back()


def slices(batch, column: str, most_bytes: int = 8 << 20) -> Iterator:
    """Parts of an Arrow batch of about most_bytes in one column each, a row at least."""
    start, size = 0, 0
    lengths = batch.column(column)
    import pyarrow.compute as pc

    for i, n in enumerate(pc.fill_null(pc.binary_length(lengths), 0).to_pylist()):
        if i > start and size + n > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)
