"""SimHash near-dedup: fingerprints of word shingles, linked within a Hamming radius through BK-trees."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from lotwise.llm.common import fresh, materialize, sized
from lotwise.llm.graph import components

BITS = 64
#: Fingerprints that share a tree, on average, before the keys that pick trees get longer.
PER_TREE = 16
#: Shards of more codes are dealt again by further bits.
LARGE = 64
_BATCH = 1 << 15


def fingerprint(text: bytes | None, shingle: int) -> int:
    """A bit is set if it is in over half of the XXH64 hashes of the shingles; 0 without words."""
    words = text.lower().split() if text else []  # of bytes: only A-Z changes, only ASCII space and \\t to \\r separate
    if not words:
        return 0
    k, n = min(shingle, len(words)), len(words)
    joined, ends = b" ".join(words), list(accumulate(map(len, words), lambda at, size: at + size + 1))
    starts = [0, *(e + 1 for e in ends)]
    ones, count = np.zeros(BITS, np.int64), n - k + 1
    for i in range(0, count, _BATCH):
        part = zip(starts[i : min(i + _BATCH, count)], ends[i + k - 1 :])
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in part], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) of every row, fp as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes)], names=["id", "fp"])
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


class Tree:
    """A BK-tree of codes, whose children are keyed by their distance to the parent, and the groups that links make."""

    def __init__(self, radius: int):
        self.radius, self.root, self.up = radius, None, []

    def group(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def meet(self, x: int) -> dict[int, int]:
        """A code within the radius of x for each group that has one.

        Below a node at distance d only edges from d - radius to d + radius can lead to one. A subtree of one group is left
        out once that group is met, so that a family of near codes is not compared all with all.
        """
        met: dict[int, int] = {}
        stack = [self.root] if self.root else []
        while stack:
            code, children, i, uniform = stack.pop()
            g = self.group(i)
            if uniform and g in met:
                continue
            d = (code ^ x).bit_count()
            if d <= self.radius and g not in met:
                met[g] = code
                if uniform:
                    continue
            low, high = d - self.radius, d + self.radius
            stack.extend(child for edge, child in children.items() if low <= edge <= high)
        return met

    def add(self, x: int) -> dict[int, int]:
        """Puts x below the child at its distance, down to a free edge, and links it with the groups that it meets."""
        met, i = self.meet(x), len(self.up)
        self.up.append(i)
        for g in met:
            self.up[g] = i
        if self.root is None:
            self.root = [x, {}, i, True]
            return met
        node = self.root
        while True:
            if node[3] and self.group(node[2]) != i:
                node[3] = False
            d = (node[0] ^ x).bit_count()
            if d not in node[1]:
                node[1][d] = [x, {}, i, True]
                return met
            node = node[1][d]


def _tree_edges(codes: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that connect the distinct codes within the radius: one for each group that a code meets in the shard's tree,
    not one for each pair."""
    tree = Tree(radius)
    return [(x, y) for x in codes for y in tree.add(x).values()]


def link(codes: list[int], radius: int, free: int = (1 << BITS) - 1) -> list[tuple[int, int]]:
    """Edges that connect what is within the radius among codes that agree outside the ``free`` bits.

    A shard of up to LARGE codes goes into BK-trees as it is. A larger one, as an uneven distribution of codes may give,
    is dealt once more: of radius + 1 parts of the free bits, codes within the radius agree on one.
    """
    if len(codes) <= LARGE or free.bit_count() <= radius:
        return _tree_edges(codes, radius)
    bits = [i for i in range(BITS) if free >> i & 1]
    cut = [round(i * len(bits) / (radius + 1)) for i in range(radius + 2)]
    edges = []
    for a, b in zip(cut, cut[1:]):
        part = sum(1 << i for i in bits[a:b])
        shards = defaultdict(list)
        for x in codes:
            shards[x & part].append(x)
        for shard in shards.values():
            if len(shard) > 1:
                edges += link(shard, radius, free & ~part) if len(shard) < len(codes) else _tree_edges(shard, radius)
    return edges


def key_masks(distinct: int, radius: int) -> list[int]:
    """Masks such that codes within the radius agree under at least one (pigeonhole): ``extra`` of ``radius + extra``
    equal blocks of bits, all choices; as many as keep PER_TREE codes or fewer to a key on average."""
    for extra in range(2, 6):
        blocks = radius + extra
        edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
        parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        masks = [sum(c) for c in combinations(parts, extra)]
        if distinct <= PER_TREE << min(m.bit_count() for m in masks):
            break
    return masks


def linked(codes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect the distinct codes (fp) whose distance is within the radius.

    The trees are sharded by key: codes that agree under a mask share a tree, built and searched in the task that
    gets them sorted. Sending codes to trees replaces the broadcast of all trees to all codes, which would grow with
    the data on both sides.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in key_masks(codes.count(), radius)]
    table = F.array(*map(F.lit, masks)).cast("array<bigint>")
    dealt = codes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t"))
    key = F.col("fp").bitwiseAND(F.get(table, F.col("t")))
    dealt = dealt.repartition("t", key).sortWithinPartitions("t", key, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.array(masks, np.int64)
        rest = [np.empty(0, np.int64), np.empty(0, np.int64)]
        def edges(fp: np.ndarray, t: np.ndarray, last: bool) -> tuple[list, list]:
            if not len(fp):
                return [fp, t], []
            k = fp & m[t]
            cut = np.flatnonzero((k[1:] != k[:-1]) | (t[1:] != t[:-1])) + 1
            start = np.r_[0, cut]
            end = np.r_[cut, len(fp)]
            if not last:  # the last run may go on in the next batch
                start, end = start[:-1], end[:-1]
            size = end - start
            found = []
            two = start[size == 2]
            close = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius]
            found += zip(fp[close].tolist(), fp[close + 1].tolist())
            u = fp.view(np.uint64)
            for a, b in zip(start[size > 2].tolist(), end[size > 2].tolist()):
                found += link(u[a:b].tolist(), radius, ~masks[int(t[a])] & (1 << BITS) - 1)
            at = int(end[-1]) if len(end) else 0
            return [fp[at:], t[at:]], found
        def out(found: list) -> pa.RecordBatch:
            pairs = np.array([(x & (2**64 - 1), y & (2**64 - 1)) for x, y in found], np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        for b in batches:
            fp, t = (np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, b.columns))
            rest, found = edges(fp, t, False)
            yield out(found)
        yield out(edges(*rest, True)[1])

    return dealt.select("fp", F.col("t").cast("long").alias("t")).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents whose SimHash fingerprints are linked, directly or over others, within the radius.

    A-Z are lower-cased; a fingerprint is taken over all word shingles of the whole text, repeats included (the whole
    sequence if it is shorter; 0 without words, and such rows link like any other). Only distinct fingerprints are
    compared, so copies cost nothing, and links are found through trees of those that share enough bits.

    Columns: id, fingerprint (16 hex digits), component_id (the smallest id reachable, its own included), n_copies
    (rows with the same fingerprint). Null texts have no words. A null id is never the smallest unless it is alone.
    Repeated rows each give a row. An empty table gives an empty result; extra columns are ignored.
    """
    rows = materialize(fingerprints(docs, shingle, id_col, text_col))
    codes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n_copies")))
    roots = components(linked(codes.select("fp"), radius))
    known = codes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = materialize(known)
    groups = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(groups, "root").select(F.col("fp").alias("c_fp"), "component_id", "n_copies")
    return rows.join(named, F.col("fp") == F.col("c_fp")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies"
    )


def keep_one(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their near duplicates: of each group the row with the smallest id, with all columns.

    Rows without an id stay. Of rows that share an id one stays: the one with the smallest text hash.
    """
    found = near_duplicates(docs, radius, shingle, id_col, text_col)
    own, hash_, least = (fresh(docs, c) for c in ("own", "hash", "least"))
    same = F.col(id_col) == F.col(own)
    out = materialize(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(own)).distinct())
    kept = docs.join(sized(out), same, "left_anti")
    many = materialize(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(own)).agg(F.count("*").alias("n")).where("n > 1").select(own))
    if many.isEmpty():
        return kept
    twice = kept.join(sized(many), same, "left_semi")
    one = twice.withColumn(hash_, F.xxhash64(*docs.columns)).dropDuplicates([id_col, hash_])
    first = one.groupBy(F.col(id_col).alias(own)).agg(F.min(hash_).alias(least))
    one = one.join(first, same & (F.col(hash_) == F.col(least)), "left_semi")
    return kept.join(sized(many), same, "left_anti").unionByName(one.select(*docs.columns))
