"""Sharding: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, Window as W, functions as F

from lotwise.llm.common import materialize

#: The text hash orders the atomic groups. Its leading BIN_BITS bits make the first bins, 2**BIN_BITS at most, and each
#: refinement splits the few bins that a cut may fall into by FINER_BITS more.
BIN_BITS, FINER_BITS = 16, 8
#: A shard's rows are numbered in so many cells, so that no task holds a whole shard.
SLOT_CELLS = 256


def fits(prefix: Sequence[int], shards: int, capacity: int) -> bool:
    """Whether a greedy pass fills at most so many shards when none may exceed the capacity."""
    at = 0
    for _ in range(shards):
        at = bisect_right(prefix, prefix[at] + capacity) - 1
        if at == len(prefix) - 1:
            return True
    return False


def smallest_capacity(sizes: Sequence[int], shards: int) -> int:
    """The least capacity under which contiguous runs of the sizes fit into the shards (binary search)."""
    prefix = [0, *accumulate(sizes)]
    low = max([0, *sizes, -(-prefix[-1] // shards)])
    high = prefix[-1]
    while low < high:
        middle = (low + high) // 2
        if fits(prefix, shards, middle):
            high = middle
        else:
            low = middle + 1
    return low


def cuts(sizes: Sequence[int], shards: int) -> list[int]:
    """Ends (exclusive) of the shards' runs: no run exceeds the smallest capacity, and within it each run comes
    as near to an equal part of what is left as the sizes allow, so that one huge unit leaves no shard idle."""
    prefix, capacity = [0, *accumulate(sizes)], smallest_capacity(sizes, shards)
    total, last = prefix[-1], len(prefix) - 1
    earliest = [last]  # from the right: what stays behind a cut must still fit
    for _ in range(shards - 1):
        earliest.append(bisect_left(prefix, prefix[earliest[-1]] - capacity))
    earliest.reverse()
    ends, at = [], 0
    for k in range(shards):
        if k == shards - 1:
            ends.append(last)
            break
        ideal = prefix[at] + (total - prefix[at]) / (shards - k)
        over = min(bisect_left(prefix, ideal, at), last)
        near = over if over <= at or prefix[over] - ideal <= ideal - prefix[over - 1] else over - 1
        furthest = bisect_right(prefix, prefix[at] + capacity) - 1
        at = max(earliest[k], min(near, furthest), at)
        ends.append(at)
    return ends


class Bin(NamedTuple):
    """A run of groups in hash order, with its sizes summed; ``single`` if it is one group and so cannot be cut."""

    first: int
    bits: int
    size: int
    single: bool


def ends_of(bins: Sequence[Bin], shards: int, capacity: int, anywhere: bool) -> list[int]:
    """Where a greedy pass ends each shard, as sums of sizes; with ``anywhere`` it may cut bins of several groups
    at any place, else no bin at all."""
    prefix, at, ends = [0, *accumulate(b.size for b in bins)], 0, []
    for _ in range(shards):
        k = bisect_right(prefix, at + capacity) - 1
        at = at + capacity if anywhere and k < len(bins) and not bins[k].single else max(at, prefix[k])
        ends.append(at)
    return ends


def bounds_of(bins: Sequence[Bin], shards: int) -> tuple[int, int]:
    """Bounds of the smallest capacity over the true groups: all bins free to be cut anywhere, and none cut."""
    total = sum(b.size for b in bins)
    found = []
    for anywhere in (True, False):
        low, high = -(-total // shards), total
        while low < high:
            middle = (low + high) // 2
            if ends_of(bins, shards, middle, anywhere)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        found.append(low)
    return found[0], found[1]


def open_bins(bins: Sequence[Bin], shards: int) -> list[Bin]:
    """The bins that must be split before the smallest capacity is known; none when it is.

    Between the two bounds, a shard's end lies between where a pass without cuts under the lower and one with free cuts
    under the upper bound puts it."""
    low, high = bounds_of(bins, shards)
    if low == high:
        return []
    large = [b for b in bins if not b.single and b.size > low]
    if large:
        return large
    prefix = [0, *accumulate(b.size for b in bins)]
    spans = list(zip(ends_of(bins, shards, low, False), ends_of(bins, shards, high, True)))
    met = {k for a, z in spans for k in range(max(bisect_right(prefix, a) - 1, 0), min(bisect_left(prefix, z), len(bins) - 1) + 1)}
    return [bins[k] for k in sorted(met) if not bins[k].single]


def binned(rows: DataFrame, *keys: str) -> list:
    return rows.groupBy(*keys, "bits").agg(F.sum("size").alias("size"), F.min("h").alias("first"), F.max("h").alias("last")).collect()


def ordered_bins(rows: DataFrame, shards: int) -> list[Bin]:
    """Bins of the rows' groups (h, size), fine enough for the exact smallest capacity."""
    make = lambda found: [Bin(r["first"], r["bits"], r["size"], r["first"] == r["last"]) for r in found]
    bins = sorted(make(binned(rows.withColumn("bits", F.lit(BIN_BITS)), "bin")))
    while split := open_bins(bins, shards):
        asked = [(b.first >> (64 - BIN_BITS), b.first >> (64 - b.bits), b.bits) for b in split]
        table = rows.sparkSession.createDataFrame(asked, "a_bin int, run long, old int")
        # as many rows as open bins: fewer than shards squared, whatever the input's size
        some = rows.join(F.broadcast(table), F.col("bin") == F.col("a_bin")).where(F.expr("shiftright(h, 64 - old) = run"))
        some = some.withColumn("bits", F.col("old") + FINER_BITS).withColumn("sub", F.expr("shiftright(h, 64 - bits)"))
        gone = set(split)
        bins = sorted([b for b in bins if b not in gone] + make(binned(some, "sub")))
    return bins


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row into one of the shards under the law ``bytes``: sizes near equal, equal texts together.

    The atomic groups, equal texts, are ordered by text hash. The binary search runs on the driver over at most 65,536
    sums of runs of groups; the runs that a cut may fall into are split, in a few more jobs, until the smallest
    feasible capacity over the groups themselves is known exactly. A shard is a range of hashes, so assigning it needs
    no join. Equal rows are counted before slots are dealt, and a row's slot is its cell's offset plus its place in the
    cell, where cells deal a shard's rows by hash: a shard, group or id that holds most rows is never numbered in one
    task.

    Columns: id, size (UTF-8 bytes and 8), text_crc32, law, shard, slot (0 up, gapless in a shard), grown_shard
    (null under this law). A null text counts as empty: size 8, crc 0. A null id is a value like any other.
    Repeated rows each get a slot. An empty table gives an empty result; extra columns are ignored. With fewer
    groups than shards, some shards stay empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.xxhash64(text)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
            h.alias("h"),
            F.shiftright(h, 64 - BIN_BITS).cast("int").alias("bin"),
        )
    )
    bins = ordered_bins(rows, shards)
    ends = cuts([b.size for b in bins], shards)
    starts = [bins[e].first for e in ends[:-1] if e < len(bins)]  # first hash of each later shard
    shard = sum((F.when(F.col("h") >= b, 1).otherwise(0) for b in starts), F.lit(0)).cast("int")
    counted = rows.groupBy("id", "size", "crc", "h").agg(F.count("*").alias("n"))
    placed = counted.select("id", "size", "crc", "h", "n", shard.alias("shard"), F.pmod(F.xxhash64("id", "h"), F.lit(SLOT_CELLS)).cast("int").alias("cell"))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "cell").agg(F.sum("n").alias("m")).select("shard", "cell", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    earlier = W.partitionBy("shard", "cell").orderBy("id", "h", "crc", "size").rowsBetween(W.unboundedPreceding, -1)
    ranked = placed.withColumn("rank", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(F.broadcast(offsets), ["shard", "cell"])  # shards x cells rows at most
    piece = F.lit(4096)  # equal rows are told apart in two steps, so that no array is long
    ranked = ranked.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / piece))))
    ranked = ranked.withColumn("place", F.explode(F.sequence(F.col("piece") * piece, F.least(F.col("n"), (F.col("piece") + 1) * piece) - 1)))
    return ranked.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("rank") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
