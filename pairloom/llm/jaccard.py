"""N-gram Jaccard join by prefixes of token combinations.

Tokens are hashed shingles. All sets are ordered alike: rare tokens first, equal ones by hash. Frequencies
come from a sketch of fixed size (BUCKETS counters over all documents); any fixed order gives the same
links, so the sketch decides speed alone.

Let two sets of sizes n and m link at share s of their union, so that they have at least o = ceil(s * n)
tokens in common. Then the first k tokens that they share are among the first n - o + k of each. Hence
- if the first shared token is rare, it stands in both prefixes for k = 1: it is indexed alone;
- if it is frequent, the pair of the first two shared tokens stands in both prefixes for k = 2: such pairs
  are indexed, as few sets share two frequent tokens near their front. In sets of over PAIR_TOKENS tokens
  pairs would be too many, and frequent tokens too are indexed alone; sets near that size do both;
- if a combination of k tokens stands in many sets, these extend it by each later token of their prefixes
  for k + 1, until lists are short. Two sets that share the k tokens alone can't meet then, but such sets
  are hardly larger than the combination, and meet it at once.
An entry's place is that of its last token. Sets with places i and j are a candidate only if
k + min(n - 1 - i, m - 1 - j) tokens can still reach s / (1 + s) * (n + m). Candidates are verified on their
whole sets.

Equal sets are one node from the start (a 64-bit hash of the set), however many documents have it. A posting
list gives all its pairs if it is short, or if they are no more than the entries that extending it would
make. Any other list names a pivot (its member with the fewest tokens before the entry), all others meet the
pivot, links merge components, and the pivot leaves, as does whoever cannot reach any member of another
component; lists whose members are all in one component are done, as their pairs can't join anything new. A list in which
that joins few components (the texts only share frequent words) is extended. So what a list makes grows
with its entries, not with their square, and no link between components is lost.

Documents: null texts and those without words have no shingles and link with nothing; repeated rows and
equal ids are rows of their own that link by their texts. component_id is the least doc_id reachable, a
null doc_id counting for nothing unless all are null. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, fold_by, give_back, slices, small_batches, table
from .shingles import M1, M2, mix, shingle_sets, signatures, signed

BUCKET_BITS = 22
BUCKETS = 1 << BUCKET_BITS
BLOCK = 1 << 16
FREQUENT = 256  # documents, beyond what other tokens add to a counter
PAIR_TOKENS = 700
SHORT = 32
SHRINKS = 0.7  # a pivot is worth another if no more than this share of a list's components is left
SHAPE = 64
SLICE = 2 << 20  # bytes of text that are shingled at once: their words and shingles take some fifty times that
LEAST_FILTER, MOST_FILTER = 16, 28  # bits of a text's hash that choose its bit in the table of wanted texts: three more than name so many texts
BROADCAST_LISTS = 100_000  # posting lists whose bounds are broadcast, at most
BROADCAST_PAIRS = 500_000  # pairs whose nodes' names are broadcast, at most
REST = 8  # tables, after which the driver collects its garbage
SEEN = 1_000_000  # nodes that a task remembers, so as to index copies once


ENTRY = "key long, node long, size int, k int, pos int"


class Share:
    """A similarity of num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least_common(self, n):
        """ceil(s * n): what a set of n tokens shares with any that it links with."""
        whole = n * self.num + self.den - 1
        return F.floor(whole / self.den).cast("int") if isinstance(n, Column) else whole // self.den

    def last(self, n, k):
        """The last place (from 0) at which a set of n tokens can have the k-th token that it shares with one that it links with."""
        return n - self.least_common(n) + k - 1

    def reachable(self, common: Column, n: Column, m: Column) -> Column:
        """Whether sets of n and m tokens with at most so many in common can link."""
        return common * (self.num + self.den) >= (n + m) * self.num

    def largest(self, common: Column, n: Column) -> Column:
        """The size of the largest set with which one of n tokens can link if they have at most so many in common."""
        return (F.floor(common * (self.num + self.den) / self.num) - n).cast("int")

    def apart(self, difference: Column, n: Column, m: Column) -> Column:
        """Whether sets that differ in so many tokens or more are too far apart to link."""
        return difference * (self.num + self.den) > (n + m) * (self.den - self.num)

    def links(self, common: Column, n: Column, m: Column) -> Column:
        return common * self.den >= (n + m - common) * self.num


def buckets_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def extended(key: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The name of a combination with one more token. A token alone is its own name."""
    with np.errstate(over="ignore"):
        return mix(mix(key) * M1 + token * M2 + M1)


def scan(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (doc_id, th, n, node; th: hash of the text; shape: its tokens counted by the rest of
    their hashes) and, with block, parts of the sketch of their tokens."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        sketch = np.zeros(BUCKETS, np.int32)
        names = ["doc_id", "th", "n", "node", "shape", "block", "task", "counts"]
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                h, ends = shingle_sets(batch.column("text"), n)
                at, more = np.unique(buckets_of(h), return_counts=True)
                sketch[at] += more.astype(np.int32)
                size = len(ends) - 1
                part = np.repeat(np.arange(size), np.diff(ends)) * SHAPE + (h % np.uint64(SHAPE)).astype(np.int64)
                shape = np.bincount(part, minlength=size * SHAPE).astype(np.int32)
                shapes = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * SHAPE), pa.array(shape))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(np.diff(ends)), pa.array(signed(signatures(h, ends))), shapes, pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary())], names=names)
        blocks = [k for k in range(BUCKETS // BLOCK) if sketch[k * BLOCK : (k + 1) * BLOCK].any()]
        packed = [zlib.compress(sketch[k * BLOCK : (k + 1) * BLOCK].astype("<i8").tobytes(), 1) for k in blocks]
        none, m = pa.nulls(len(blocks), pa.int64()), len(blocks)
        del sketch
        give_back()
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(m, pa.list_(pa.int32())), pa.array(blocks, pa.int32()), pa.array([TaskContext.get().partitionId()] * m, pa.int64()), pa.array(packed, pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("th")).mapInArrow(count, "doc_id long, th long, n long, node long, shape array<int>, block int, task long, counts binary")


def sketch_of(scanned: DataFrame) -> np.ndarray:
    """The whole sketch: BUCKETS counters, whatever the input."""

    def add(t):
        import pyarrow as pa

        total = sum(np.frombuffer(zlib.decompress(b), "<i8") for b in t["counts"].to_pylist())
        return pa.table([t["block"].slice(0, 1).combine_chunks(), t["task"].slice(0, 1).combine_chunks(), pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], names=["block", "task", "counts"])

    out = np.zeros(BUCKETS, np.int64)
    for r in fold_by(scanned.where("block is not null").select("block", "task", "counts"), "block", add).toLocalIterator():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return out


def ranks_of(sketch: np.ndarray) -> tuple[np.ndarray, int]:
    """Each counter on a scale of logarithms, and the rank from which tokens are frequent."""
    scale = lambda c: np.minimum(2048 * np.log2(1.0 + c), 65_535).astype(np.uint16)
    median = float(np.median(sketch))
    return scale(sketch), int(scale(np.array([median + 8 * np.sqrt(median) + FREQUENT]))[0])


def entries(docs: DataFrame, n: int, share: Share, sent, frequent: int) -> DataFrame:
    """key, node, size, k, pos: the index. sent: the ranks, broadcast."""
    least = 1
    while share.least_common(least) >= least and least < 1000:  # smaller sets link with equal ones only
        least += 1
    overlap = int(PAIR_TOKENS * share.num / share.den)

    def index(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ranks, seen = sent.value, set()
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                h, ends = shingle_sets(batch.column("text"), n)
                sig = signatures(h, ends)
                keys, nodes, sizes, ks, places = [], [], [], [], []
                rank = ranks[buckets_of(h)]
                for k, name in enumerate(sig.tolist()):
                    a, b = int(ends[k]), int(ends[k + 1])
                    size = b - a
                    if size + 1 < least or name in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    p = share.last(size, 1) + 1
                    own, r = h[a:b], rank[a:b]
                    order = np.argsort(r, kind="stable")[: p + 1]  # the hashes ascend already
                    own, often = own[order], r[order] > frequent
                    alone = np.ones(p, bool) if size > PAIR_TOKENS else ~often[:p]
                    if overlap <= size <= PAIR_TOKENS or share.least_common(size) < 2:  # or a link need not share two
                        alone[:] = True
                    single = np.flatnonzero(alone)
                    keys.append(own[single])
                    places.append(single)
                    ks.append(np.ones(len(single), np.int32))
                    found = len(single)
                    if size <= PAIR_TOKENS and often[:p].any():
                        i, j = np.triu_indices(len(own), 1)
                        of = (i < p) & often[i]
                        i, j = i[of], j[of]
                        keys.append(extended(own[i], own[j]))
                        places.append(j)
                        ks.append(np.full(len(i), 2, np.int32))
                        found += len(i)
                    nodes.append(np.full(found, sig[k], np.uint64))
                    sizes.append(np.full(found, size, np.int32))
                if keys:
                    columns = [signed(np.concatenate(keys)), signed(np.concatenate(nodes)), np.concatenate(sizes), np.concatenate(ks), np.concatenate(places).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "size", "k", "pos"])
        give_back()

    return docs.select(F.col("text").cast("string")).mapInArrow(index, ENTRY)


def sets_of(docs: DataFrame, n: int, sent, wanted: np.ndarray, high: int) -> DataFrame:
    """node, tokens (in the order of all sets) for documents whose bit, by the high bits of the text's hash, is set in wanted (and for a few others)."""
    spark = docs.sparkSession
    asked = spark.sparkContext.broadcast(np.packbits(wanted))

    def pick(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits, ranks = np.unpackbits(asked.value), sent.value
        for whole in batches:
            ours = bits[(whole.column("th").to_numpy().view(np.uint64) >> np.uint64(64 - high)).astype(np.int64)].astype(bool)
            for batch in slices(whole.filter(pa.array(ours)), "text", SLICE):
                h, ends = shingle_sets(batch.column("text"), n)
                doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                order = np.lexsort((ranks[buckets_of(h)], doc))  # stable: equal ranks by hash
                yield pa.RecordBatch.from_arrays([pa.array(signed(signatures(h, ends))), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed(h[order])))], names=["node", "tokens"])
        give_back()

    return docs.select(F.col("text").cast("string"), F.xxhash64("text").alias("th")).mapInArrow(pick, "node long, tokens array<long>")


def longer(lists: DataFrame, sets: DataFrame, share: Share) -> DataFrame:
    """Entries extended by each later token with which they may go on."""

    def grow(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            tokens, held = batch.column("tokens"), batch.column("held")
            at, key, k, pos = held.offsets.to_numpy(), *(held.values.field(c).to_numpy() for c in ("key", "k", "pos"))
            ends, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy().view(np.uint64)
            sizes, nodes = np.diff(ends), batch.column("node").to_numpy()
            for r, size in enumerate(sizes.tolist()):
                own = slice(at[r], at[r + 1])
                room = np.maximum(np.minimum(share.last(size, k[own] + 1), size - 1) - pos[own], 0)
                of = np.repeat(np.arange(at[r], at[r + 1]), room)
                place = pos[of] + 1 + np.arange(len(of)) - np.repeat(np.cumsum(room) - room, room)
                names = extended(key[of].view(np.uint64), flat[ends[r] + place])
                columns = [signed(names), np.full(len(of), nodes[r]), np.full(len(of), size, np.int32), (k[of] + 1).astype(np.int32), place.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "size", "k", "pos"])

    held = lists.groupBy("node").agg(F.collect_list(F.struct("key", "k", "pos")).alias("held"))
    return held.join(sets, "node").select("node", "held", "tokens").mapInArrow(grow, ENTRY)


def bits_of(hashes: DataFrame, high: int) -> np.ndarray:
    """A table of 2**high bits, those of the hashes (th) set."""
    place = F.shiftrightunsigned("th", 64 - high)
    words = hashes.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(th, {64 - high}) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    t = words.toArrow()
    out = np.zeros((1 << high) // 64, np.uint64)
    out[t["w"].to_numpy()] = t["b"].to_numpy().view(np.uint64)
    return ((out[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp (the least node reachable) for nodes with links, by smallest neighbours and jumps."""
    both = scratch.keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        jump = label.select(F.col("node").alias("to"), F.col("comp").alias("further"))
        new = scratch.keep(step.join(jump, "to", "left").select("node", F.coalesce("further", "to").alias("comp"), "was"), "labels")
        moved = new.where("comp <> was").limit(1).count()
        scratch.drop(label)
        label = new.select("node", "comp")
        label.scratch_path = new.scratch_path  # type: ignore[attr-defined]
        if not moved:
            scratch.drop(both)
            return label


def linked(docs: DataFrame, n: int, share: Share, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Documents (doc_id, th, n, node), and node, comp for nodes that link with others.

    Joins of all entries are merge joins, whose large keys Spark can split. In the turns over long lists, the
    sets that the pairs of a turn name are picked where they lie, so that a few pairs move a few sets.
    """
    scanned = scratch.keep(scan(docs, n), "scan")
    rows = scanned.where("block is null")
    nodes = rows.select("doc_id", "th", "n", "node")
    ranks, frequent = ranks_of(sketch_of(scanned))
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    index = scratch.keep(entries(docs, n, share, sent, frequent), "index")
    several = index.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count(F.lit(1)).alias("members")).where("x <> y").select("key", "members")
    posted = scratch.keep(index.join(several.hint("merge"), "key").distinct(), "posted")
    scratch.drop(index)

    def common(side: str = "") -> Column:
        """The most tokens that a set with the entry can have in common with another."""
        return F.col(f"{side}k") + F.col(f"{side}size") - 1 - F.col(f"{side}pos")

    def paired(rows: DataFrame, apart: Column) -> DataFrame:
        may = share.reachable(F.least(common("l."), common("r.")), F.col("l.size"), F.col("r.size"))
        return rows.alias("l").join(rows.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")) & apart & may).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))

    pairs = scratch.keep(paired(posted.where(F.col("members") <= SHORT), F.lit(True)).distinct(), "pairs")
    lists = scratch.keep(posted.where(F.col("members") > SHORT).drop("members"), "long")
    scratch.drop(posted)
    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(lists.select("node")).distinct()
    chosen = scratch.keep(rows.join(met.hint("merge"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("th", "n", "shape")).alias("s")).select("node", "s.*"), "chosen")
    if not chosen.limit(1).count():
        return nodes, None

    def named(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """The rows of nodes that pairs (a written table) name, written."""
        names = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        names = F.broadcast(names) if pairs.count() <= BROADCAST_PAIRS else names.hint("merge")
        return scratch.keep(rows.join(names, "node", "left_semi"), "named")

    def near(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """Pairs whose shapes (of: their nodes) do not rule them out: sets differ in no fewer tokens than their shapes do."""
        side = lambda to, name: of.select(F.col("node").alias(to), F.col("n").alias(f"n{name}"), F.col("shape").alias(f"shape{name}"))
        both = pairs.join(side("a", "1"), "a").join(side("b", "2"), "b")
        differ = F.aggregate(F.zip_with("shape1", "shape2", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
        return both.where(~share.apart(differ, F.col("n1"), F.col("n2"))).select("a", "b")

    scratch_pairs, pairs = pairs, scratch.keep(near(pairs, chosen), "near")
    scratch.drop(scratch_pairs)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(lists.select("node")).distinct()
    wanted = scratch.keep(chosen.select("node", "th").join(wanted.hint("merge"), "node", "left_semi"), "wanted")
    high = min(MOST_FILTER, max(LEAST_FILTER, wanted.count().bit_length() + 3))
    sets = sets_of(docs, n, sent, bits_of(wanted, high), high).join(wanted.select("node"), "node", "left_semi")
    sets = scratch.keep(sets.groupBy("node").agg(F.first("tokens").alias("tokens")), "sets")

    def verified(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """Pairs that link. of: the sets of their nodes."""
        first = pairs.join(of.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
        full = first.join(of.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return full.where(share.links(shared, F.size("x"), F.size("y"))).select("a", "b")

    links = scratch.keep(verified(pairs, sets), "links")
    comps = components(links, scratch)
    lists = lists.withColumn("was", F.lit(None).cast("long"))  # the list's components when it last had a pivot
    while True:
        now = lists.join(comps.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node")).withColumn("most", share.largest(common(), F.col("size")))
        now = scratch.keep(now, "now")
        more = F.greatest(F.least(share.last(F.col("size"), F.col("k") + 1), F.col("size") - 1) - F.col("pos"), F.lit(0))
        kinds = now.groupBy("key", "comp").agg(F.min("size").alias("least"), F.max("most").alias("most"), F.count(F.lit(1)).alias("members"), F.sum(more).alias("room"), F.min(F.struct("pos", "size", "node", "comp")).alias("pivot"))
        kinds = scratch.keep(kinds, "kinds")
        stats = kinds.groupBy("key").agg(F.min(F.struct("least", "comp")).alias("low"), F.max(F.struct("most", "comp")).alias("high"), F.count(F.lit(1)).alias("kinds"), F.sum("members").alias("members"), F.sum("room").alias("room"), F.min("pivot").alias("pivot"))
        stats = scratch.keep(stats.where("kinds > 1"), "lists")
        second = kinds.join(stats.select("key", "low", "high").hint("merge"), "key").groupBy("key")
        second = second.agg(F.min(F.when(F.col("comp") != F.col("low.comp"), F.col("least"))).alias("low2"), F.max(F.when(F.col("comp") != F.col("high.comp"), F.col("most"))).alias("high2"))
        # of other components, the smallest set must be small enough for a member, and the member for the set that can link with the largest
        least = F.when(F.col("comp") == F.col("low.comp"), F.col("low2")).otherwise(F.col("low.least"))
        most = F.when(F.col("comp") == F.col("high.comp"), F.col("high2")).otherwise(F.col("high.most"))
        bounds = scratch.keep(stats.join(second.hint("merge"), "key"), "bounds")
        bounds = F.broadcast(bounds) if bounds.count() <= BROADCAST_LISTS else bounds.hint("merge")
        active = now.join(bounds, "key").where((least <= F.col("most")) & (F.col("size") <= most))
        active = scratch.keep(active.drop("low", "high", "low2", "high2", "most"), "active")
        if not active.limit(1).count():
            break
        few = (F.col("members") <= SHORT) | (F.col("members") * (F.col("members") - 1) <= 2 * F.col("room"))
        other = F.col("l.comp") != F.col("r.comp")
        grows = ~few & (F.col("kinds") > F.col("was") * SHRINKS)
        goes_on = ~few & ~F.coalesce(grows, F.lit(False))
        pairs = paired(active.where(few), other)
        p = F.col("pivot")
        before = share.reachable(F.least(common(), F.col("k") + p["size"] - 1 - p["pos"]), F.col("size"), p["size"])
        meets = active.where(goes_on & (F.col("comp") != p["comp"]) & before)
        pairs = pairs.unionByName(meets.select(F.least("node", p["node"]).alias("a"), F.greatest("node", p["node"]).alias("b")))
        done = scratch.keep(active.where(grows).select("key", "node", "size", "k", "pos", "comp"), "extended")
        # sets that share the combination alone: the smaller one has hardly more tokens
        l, r = done.where((2 * F.col("size") - F.col("k")) * share.num <= F.col("k") * share.den).alias("l"), done.alias("r")
        alone = share.links(F.col("l.k"), F.col("l.size"), F.col("r.size")) & ((F.col("l.size") < F.col("r.size")) | ((F.col("l.size") == F.col("r.size")) & (F.col("l.node") < F.col("r.node"))))
        pairs = pairs.unionByName(l.join(r, (F.col("l.key") == F.col("r.key")) & alone & other).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")))
        tried = scratch.keep(pairs.distinct(), "tried")
        shapes = named(chosen, tried)
        close = scratch.keep(near(tried, shapes), "near")
        if close.limit(1).count():
            found = scratch.keep(verified(close, held := named(sets, close)), "links")
            links = links.unionByName(found)
            if found.limit(1).count():
                scratch.drop(comps)
                comps = components(links, scratch)
            scratch.drop(held)
        again = active.where(goes_on & (F.col("node") != p["node"])).select("key", "node", "size", "k", "pos", F.col("kinds").alias("was"))
        new = longer(done, sets, share).withColumn("was", F.lit(None).cast("long"))
        old, lists = lists, scratch.keep(again.unionByName(new), "long")
        for df in (old, now, kinds, stats, active, done, tried, shapes, close):
            scratch.drop(df)
    scratch.drop_but(scanned, comps)
    return nodes, comps


def join(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id, and th (hash of the text), comp (the component's name, 0 without words): a row for each document."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "jaccard", REST)
    nodes, comps = linked(docs, n, Share(num, den), scratch)
    of = nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    of = of.join(comps.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node")) if comps is not None else of.withColumn("comp", F.col("node"))
    roots = of.groupBy("comp").agg(F.min("least").alias("component_id"))
    out = nodes.join(of.join(roots.hint("merge"), "comp").select("node", "comp", "component_id").hint("merge"), "node", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "th", F.coalesce("comp", F.lit(0)).cast("long").alias("comp"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs with one row of each component: that of its least doc_id (null last; among equal ids, the least hash of the text). Those without words stay."""
    scratch = Scratch(docs.sparkSession, "one-of-each")
    rows = scratch.keep(join(docs, n, num, den).where("n_shingles > 0").select("doc_id", "th", "comp"), "rows")
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    lost = rows.join(first.hint("merge"), "comp").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))))
    is_row = lambda of: docs["doc_id"].eqNullSafe(of["gone_id"]) & (F.xxhash64(docs["text"]) == of["gone_th"])
    named = lambda of: of.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    kept = docs.join(gone := named(lost), is_row(gone), "left_anti")
    often = scratch.keep(named(rows.groupBy("doc_id", "th").count().where("count > 1")), "repeated")
    if not often.limit(1).count():
        return kept
    once = kept.join(often, is_row(often), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(often, is_row(often), "left_anti").unionByName(once)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def oracle() -> str:
    words = f"list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * k >= 90 * (p.n + q.n - k)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS y FROM r GROUP BY 1) m USING (doc_id)
"""
