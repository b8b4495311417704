"""Near-dedup by the Jaccard similarity of word shingles: SimHash links and, for what those miss, bands of minima, all
verified exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from lotwise.llm.common import fresh, materialize, sized, small_batches
from lotwise.llm.graph import components
from lotwise.llm.simhash import BITS, linked

#: Words of a shingle, and the least similarity of near copies in tenths.
SHINGLE, TENTHS = 5, 8
#: Minima of a band, and bands: a pair at similarity s shares no band with probability (1 - s^6)^40, 5e-6 at 0.8.
ROWS, BANDS = 6, 40
WORDS = -(-ROWS * BANDS // 64)
_MIX = np.random.default_rng(42).integers(0, 1 << 63, (ROWS * BANDS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_BATCH = 1 << 11
#: Rows whose sets a task holds at a time.
PART = 256
#: Bits in which SimHash codes may differ to be linked first. At a similarity of 0.8 about 10 of 64 differ.
LINKED = 4
#: Of a set's minima one bit each is kept. Members of a band are compared if at most so many differ: at 0.8 a tenth of
#: the bits does, 24 of 240 with a deviation of 4.7; at 0.6 already 48.
DIFFERING = 45


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, A-Z lower-cased; the whole sequence is one if it is shorter; none
    without words."""
    words = text.lower().split() if text else []  # of bytes: only A-Z changes, only ASCII space and \\t to \\r separate
    if not words:
        return np.empty(0, np.uint64)
    k, n = min(shingle, len(words)), len(words)
    joined, ends = b" ".join(words), list(accumulate(map(len, words), lambda at, size: at + size + 1))
    starts = [0, *(e + 1 for e in ends)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: n - k + 1], ends[k - 1 :])), np.uint64, n - k + 1))


def minima(hashes: np.ndarray) -> np.ndarray:
    """For every factor the least of the hashes times it."""
    least = np.full(len(_MIX), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _BATCH):
        np.minimum(least, (hashes[i : i + _BATCH] * _MIX).min(axis=1), out=least)
    return least


def bits_of(least: np.ndarray) -> np.ndarray:
    """One bit of each minimum, as WORDS numbers of 64 bits."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[: len(least)] = (least >> np.uint64(7)) & np.uint64(1)
    return np.packbits(bits, bitorder="little").view("<u8")


def band_keys(least: np.ndarray) -> np.ndarray:
    """For each band a key made of its ROWS minima."""
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def simhash_code(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _BATCH):
        ones += np.unpackbits(hashes[i : i + _BATCH].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, n, fp, bits, bands, shingles) of every row; node tells distinct sets apart, and rows of one node are copies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(i, PART) for batch in batches for i in range(0, batch.num_rows, PART)):
            sets = [shingle_set(t.as_py()) for t in b.column(1)]
            node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            codes = np.array([simhash_code(s) for s in sets], np.uint64).view(np.int64)
            least = [minima(s) for s in sets]
            bands = np.array([band_keys(x) for x in least], np.uint64).reshape(-1).view(np.int64)
            bits = np.array([bits_of(x) for x in least], np.uint64).reshape(-1).view(np.int64)
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int64)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            wide = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.int64()))
            lists = lambda size, values: pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * size), pa.array(values))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node), pa.array(np.diff(ends)), pa.array(codes), lists(WORDS, bits), lists(BANDS, bands), wide], names=["id", "node", "n", "fp", "bits", "bands", "shingles"])
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bits", longs), T.StructField("bands", longs), T.StructField("shingles", longs)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, compared in whole numbers."""
    asked = materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    some = materialize(sets.join(sized(asked), "node", "left_semi").dropDuplicates(["node"]).select("node", "n", "shingles"))
    side = lambda c: some.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("shingles").alias(f"s_{c}"))
    # the narrow pairs meet a's set first and b's after
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    shared, total = F.size(F.array_intersect("s_a", "s_b")), F.col("n_a") + F.col("n_b")
    return both.where((10 + TENTHS) * shared >= TENTHS * total).select("a", "b")


def _by_runs(pairs: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]]):
    """Applies a function to each run of rows with one band and key, from rows sorted by these; it gets the other columns,
    the bits as a matrix, and yields pairs of nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            column = lambda i: t.column(i).to_numpy()
            bits = np.stack([column(4 + i) for i in range(WORDS)], axis=1).view(np.uint64)
            for a, b in pairs(column(2), column(3), bits, *t.columns[4 + WORDS :]):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held: list[pa.RecordBatch] = []  # parts of the run that the last batch ended in
        for b in batches:
            if not b.num_rows:
                continue
            band, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (band[0], key[0]):
                yield from out(pa.Table.from_batches(held))
                held = []
            cut = np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1])) + 1
            for start, end in zip(np.r_[0, cut], np.r_[cut, len(band)]):
                held.append(b.slice(start, end - start))
                if end < len(band):
                    yield from out(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from out(pa.Table.from_batches(held))
    return run


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sets of very different size cannot be similar enough."""
    return 10 * np.minimum(a, b) >= TENTHS * np.maximum(a, b)


def _to_middle(node: np.ndarray, n: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each member with the one that is nearest to what most members' bits say: of copies that were edited each in its own
    way, the original, to which all are similar while they are not to each other."""
    if len(node) > 2:
        ones = sum(np.unpackbits(bits[i : i + 4096].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(bits), 4096))
        middle = np.packbits(2 * ones > len(bits), bitorder="little").view("<u8")
        at = np.lexsort((node, np.bitwise_count(bits ^ middle).sum(axis=1)))[0]
    else:
        at = int(np.argmin(node))
    near = (np.bitwise_count(bits ^ bits[at]).sum(axis=1) <= DIFFERING) & _fits(n, n[at]) & (node != node[at])
    yield node[near], np.full(int(near.sum()), node[at])


def _shared(x: list[np.ndarray], y: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles x[a] and y[b] share, for each pair; by a matrix product where sets are many and short."""
    if len(a) > 64:
        known = np.unique(np.concatenate([*x, *y]))
        if len(known) * (len(x) + len(y)) <= 1 << 24:
            def matrix(sets: list[np.ndarray]) -> np.ndarray:
                m = np.zeros((len(sets), len(known)), np.float32)
                for i, s in enumerate(sets):
                    m[i, np.searchsorted(known, s)] = 1
                return m
            return (matrix(x) @ matrix(y).T)[a, b].astype(np.int64)
    return np.array([len(np.intersect1d(x[i], y[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())], np.int64)


def _unlike_roots(node: np.ndarray, n: np.ndarray, bits: np.ndarray, root: pa.ChunkedArray, shingles: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different roots that are similar, enough of them to connect what is; verified here, block by block, so that
    of all the pairs of a run only these are put out."""
    root = root.to_numpy().copy()
    sets = [s.values.to_numpy() for s in shingles]
    for i in range(0, len(node), 128):
        for j in range(i, len(node), 128):
            x, y = slice(i, i + 128), slice(j, j + 128)
            a, b = np.nonzero((root[x, None] != root[None, y]) & _fits(n[x, None], n[None, y]))
            close = np.bitwise_count(bits[x][a] ^ bits[y][b]).sum(axis=1) <= DIFFERING
            a, b = a[close], b[close]
            if not len(a):
                continue
            alike = (10 + TENTHS) * _shared(sets[x], sets[y], a, b) >= TENTHS * (n[x][a] + n[y][b])
            found = []
            for p, q in zip((a[alike] + i).tolist(), (b[alike] + j).tolist()):
                if root[p] != root[q]:
                    root[root == root[q]] = root[p]
                    found.append((node[p], node[q]))
            if found:
                one, other = np.array(found, np.int64).T
                yield one, other


def near_copies(sets: DataFrame) -> DataFrame:
    """(node, root) of every node that has near copies: components of pairs with Jaccard similarity 0.8 or more.

    SimHash codes of the shingle sets are linked within LINKED bits through BK-trees, as in the operator itself. Pairs
    at 0.8 often differ in more bits, so a band's members are also compared with their middle one. All of these pairs are
    verified, and what is similar becomes one component. Then members of one band that are still in different components
    are compared with each other by their bits and, where these are near enough, by their shingles, which are sent to the
    bands for it. So every group costs a row a member, and no pair that shares a band stays unasked where the answer
    would change a component. What is left of a band after the first step is compared in one task, in blocks.
    """
    words = [f"w{i}" for i in range(WORDS)]
    nodes = sets.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    codes = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.max("node").alias("most")))
    close = materialize(linked(codes.select("fp"), LINKED))
    name = lambda c: codes.select(F.col("fp").alias(f"fp_{c}"), F.col("least").alias(c))
    close = close.select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(name("a"), "fp_a").join(name("b"), "fp_b").select("a", "b")
    same = nodes.select("node", "fp").join(codes.where("least < most"), "fp").where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    dealt = nodes.select("node", "n", *(F.get("bits", F.lit(i)).alias(w) for i, w in enumerate(words)), F.posexplode("bands").alias("band", "key")).withColumn("band", F.col("band").cast("long"))
    shared = materialize(dealt.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1").select("band", "key"))
    # bands of one member are most of them and go here
    met = materialize(dealt.join(shared.hint("merge"), ["band", "key"]).select("band", "key", "node", "n", *words))
    runs = lambda rows, pairs: rows.repartition("band", "key").sortWithinPartitions("band", "key").mapInArrow(_by_runs(pairs), "a long, b long").distinct()
    star = runs(met, _to_middle).unionByName(close).unionByName(same)
    star = materialize(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    edges = materialize(_verified(star, sets))
    roots = components(edges)
    now = met.join(sized(roots), "node", "left").select("band", "key", "node", "n", *words, F.coalesce("root", "node").alias("root"))
    split = now.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", "key")
    rest = materialize(now.join(materialize(split).hint("merge"), ["band", "key"]).select("band", "key", "node", "n", *words, "root"))
    some = materialize(sets.join(sized(materialize(rest.select("node").distinct())), "node", "left_semi").dropDuplicates(["node"]).select("node", "shingles"))
    wide = rest.join(some.hint("merge"), "node").select("band", "key", "node", "n", *words, "root", "shingles")
    cross = materialize(runs(wide, _unlike_roots))
    if cross.isEmpty():
        return roots
    return components(edges.unionByName(cross))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their near copies: of each component of shingle sets with a Jaccard similarity of 0.8 or
    more the row with the smallest id stays, with all its columns.

    Texts without words are copies of each other. Rows without an id stay. Of rows that share id and shingles the one
    with the smallest hash stays; rows that share an id alone are judged each by its own text.
    """
    with small_batches(docs.sparkSession):  # rows carry texts and shingle sets; all of this Python work ends in here
        return _without_copies(docs, id_col, text_col)


def _without_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    sets = materialize(shingle_sets(docs, id_col, text_col))
    roots = near_copies(sets)
    known = sets.where("id is not null").select("id", "node").join(sized(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = materialize(known.select("id", "node", "root"))
    first = rows.groupBy("root").agg(F.min(F.struct("id", "node")).alias("first"), F.count("*").alias("members")).where("members > 1")
    many = rows.join(sized(materialize(first.select("root", "first"))), "root")
    out = materialize(many.where(F.struct("id", "node") != F.col("first")).select("id", "node").distinct())
    again = materialize(rows.groupBy("id").agg(F.count("*").alias("members")).where("members > 1").select("id"))
    own = fresh(docs, "own")
    of = lambda ids: sized(ids.select(F.col("id").alias(own)))
    same = F.col(id_col) == F.col(own)
    if again.isEmpty():  # an id names its row
        return docs.join(of(out), same, "left_anti")
    repeated = docs.where(F.col(id_col).isNotNull()).join(of(again), same, "left_semi")
    single = docs.join(of(again), same, "left_anti")
    single = single.join(of(out.select("id").distinct()), same, "left_anti")
    set_, bytes_, hash_, of_set, least = (fresh(docs, c) for c in ("node", "bytes", "hash", "own_node", "least"))
    schema = T.StructType([*docs.schema.fields, T.StructField(set_, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            node = np.array([xxhash.xxh3_64_intdigest(shingle_set(t.as_py()).tobytes()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(node)], names=[*b.schema.names[:-1], set_])

    keyed = repeated.withColumn(bytes_, F.col(text_col).cast("binary")).mapInArrow(run, schema)
    gone = out.select(F.col("id").alias(own), F.col("node").alias(of_set))
    same = same & (F.col(set_) == F.col(of_set))
    left = keyed.join(sized(gone), same, "left_anti")
    left = materialize(left.withColumn(hash_, F.xxhash64(*docs.columns)).dropDuplicates([id_col, set_, hash_]))
    one = left.groupBy(F.col(id_col).alias(own), F.col(set_).alias(of_set)).agg(F.min(hash_).alias(least))
    left = left.join(one, same & (F.col(hash_) == F.col(least)), "left_semi")
    return single.unionByName(left.select(*docs.columns))
