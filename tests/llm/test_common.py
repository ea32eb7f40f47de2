import pyarrow as pa
import pytest

from pairloom.llm.common import Scratch, fold_by, rest_driver, slices


@pytest.mark.parametrize("fan", [2, 7, 32])
def test_fold_by(spark, fan):
    rows = spark.range(300).selectExpr("cast(id % 3 as int) as k", "cast(id div 3 as bigint) as task", "id as v")

    def add(t):
        return pa.table([t["k"].slice(0, 1).combine_chunks(), t["task"].slice(0, 1).combine_chunks(), pa.array([sum(t["v"].to_pylist())], pa.int64())], names=["k", "task", "v"])

    got = {r.k: r.v for r in fold_by(rows, "k", add, fan).collect()}
    assert got == {k: sum(range(k, 300, 3)) for k in range(3)}
    assert fold_by(rows.limit(0), "k", add, fan).count() == 0


def test_scratch(spark):
    s = Scratch(spark, "test")
    kept = s.keep(spark.range(5), "five")
    assert kept.count() == 5 and spark.conf.get("spark.checkpoint.dir") in kept.scratch_path
    s.drop(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(kept.scratch_path).count()


def full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if any(x in b.getName() for x in ("Old", "MarkSweep")))


def test_the_driver_rests_after_tables(spark):
    before = full_collections(spark)
    s = Scratch(spark, "rests", rest=2)
    for _ in range(4):
        s.keep(spark.range(5), "five")
    assert full_collections(spark) >= before + 2
    rest_driver(spark)
    assert full_collections(spark) >= before + 3


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 30, "", "c" * 5])], names=["text"])
    parts = list(slices(batch, "text", 12))
    assert [p.column("text").to_pylist() for p in parts] == [["a" * 10, None], ["b" * 30], ["", "c" * 5]]
    assert not list(slices(batch.slice(0, 0), "text", 12))
