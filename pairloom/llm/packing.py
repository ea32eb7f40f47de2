"""Hierarchical residual packing of documents into sequences.

Each partition packs its own pieces best-fit (largest first, each into the fullest bin that has room)
and emits its nearly full bins. The underfull bins go on as items: FAN groups at a time meet in a task,
which packs these bins best-fit into larger ones, emits those that are nearly full by now, and so on up
the tree to one group. What counts as nearly full widens from round to round (SLACK, times 4), so what
reaches the top stays small while no bin is given up early.

A document's ids are its tokens and a 0. Only those longer than a sequence are cut, into whole sequences
and a rest. A null text is one id. Documents are kept apart by row: repeated rows and ids are packed
each. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back, slices, small_batches, table
from .tokens import ENCODE_BYTES, ENCODE_ROWS, vocabulary_path, word_ids

CAPACITY = 2048
FAN = 8
SLACK = 8  # a bin with so few free places is full
CHUNK = 1 << 16  # items that a task packs at once
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, level int, grp long, bin long, size long, offset long, done boolean"
Step = Callable[[Iterator], Iterator]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing. Returns each item's bin and place there, and the bins' sizes.

    Bins with room r lie on a stack open_[r]; bit r of mask says that it has any. The fullest bin that an
    item fits is the lowest bit from its size on.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, filled = 0, []
    for i in order.tolist():
        n = int(sizes[i])
        room = mask >> n
        if room:
            r = n + (room & -room).bit_length() - 1
            b = open_[r].pop()
            if not open_[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(filled)
            filled.append(0)
        bins[i], places[i] = b, filled[b]
        filled[b] += n
        if r > n:
            open_[r - n].append(b)
            mask |= 1 << (r - n)
    return bins, places, filled


def cutter(path: str, capacity: int) -> Step:
    """From doc_id, text to the pieces of each document, unpacked."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = word_ids(path)
        for whole in batches:
            for batch in slices(whole, "text", ENCODE_BYTES):
                ids, ends = words.encode(batch.column("text"))
                names, rows = batch.column("doc_id").to_pylist(), []
                for d, a, b in zip(names, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], 0).astype("<u4")
                    rows += [(d, k, s, min(capacity, len(own) - s), zlib.crc32(own[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(own), capacity))]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return cut


def filler(capacity: int, slack: int = SLACK) -> Step:
    """From a partition's pieces to these packed best-fit, CHUNK at a time."""

    def fill(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        group, used, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def packed(held, used):
            t = pa.Table.from_batches(held)
            bins, places, filled = best_fit(t["length"].to_numpy(), capacity)
            size = np.array(filled, np.int64)[bins]
            n = len(bins)
            more = [np.zeros(n, np.int32), np.full(n, group, np.int64), bins + used, size, places, capacity - size <= slack]
            for name, col in zip(("level", "grp", "bin", "size", "offset", "done"), more, strict=True):
                t = t.append_column(name, pa.array(col))
            return t.to_batches(), used + len(filled)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                out, used = packed(held, used)
                yield from out
                held, rows = [], 0
        if rows:
            yield from packed(held, used)[0]

    return fill


def pack_local(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Best-fit in each partition."""
    return pieces.mapInArrow(filler(capacity), PACKED)


def merge_round(rest: DataFrame, level: int, capacity: int, slack: int, fan: int = FAN) -> DataFrame:
    """Packs the underfull bins of fan groups at a time, whole bins as items."""

    def merge(t):
        import pyarrow as pa

        grp, old = t["grp"].to_numpy(), t["bin"].to_numpy()
        keys, first, of = np.unique(np.stack([grp, old]), axis=1, return_index=True, return_inverse=True)
        of = of.ravel()
        bins, places, filled = best_fit(t["size"].to_numpy()[first], capacity)
        size = np.array(filled, np.int64)[bins][of]
        new = {
            "level": np.full(len(of), level, np.int32),
            "grp": grp // fan,
            "bin": bins[of],
            "size": size,
            "offset": t["offset"].to_numpy() + places[of],
            "done": capacity - size <= slack,
        }
        names = t.schema.names
        return pa.Table.from_arrays([pa.array(new[c]) if c in new else t[c] for c in names if c != "up"], names=[c for c in names if c != "up"])

    return rest.withColumn("up", F.floor(F.col("grp") / fan)).groupBy("up").applyInArrow(merge, PACKED)


def pack(pieces: DataFrame, capacity: int = CAPACITY, fan: int = FAN) -> DataFrame:
    """pieces with sequence_id and offset."""
    return merged(pack_local(pieces, capacity), capacity, fan)


def merged(local: DataFrame, capacity: int = CAPACITY, fan: int = FAN) -> DataFrame:
    """The bins of all partitions, merged up the tree."""
    scratch = Scratch(local.sparkSession, "pack")
    level, slack = 0, SLACK
    table_ = scratch.keep(local, "local")
    finished = []
    while True:
        rest = table_.where(~F.col("done"))
        top = rest.agg(F.max("grp")).first()[0]
        if top is None or (level and top == 0):
            finished.append(table_)
            break
        finished.append(table_.where("done"))
        level, slack = level + 1, min(slack * 4, capacity // 2)
        table_ = scratch.keep(merge_round(rest, level, capacity, slack, fan), f"merge{level}")
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    sequence = F.shiftleft(F.col("level").cast("long"), 58) + F.shiftleft(F.col("grp"), 34) + F.col("bin")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Cuts and packs in one worker a task: a second one beside it would hold another 100 MB and more."""
    small_batches(docs.sparkSession, ENCODE_ROWS)
    cut, fill = cutter(path or vocabulary_path(), capacity), filler(capacity)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return merged(texts.mapInArrow(lambda batches: fill(cut(batches)), PACKED), capacity)


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
