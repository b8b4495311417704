"""Substring dedup: winnowed anchors as seeds, extended both ways to the repeats over a length of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from lotwise.llm.common import materialize, sized

#: Words of a seed. Of the seeds in a window of words, the one with the least hash is its anchor.
SEED = 5
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes kept of a word's hash in a seed's surroundings: 13 equal words are 500 equal bits.
_BYTES = 6


def _runs(hashes: np.ndarray, k: int, m: np.uint64) -> np.ndarray:
    """A hash for every run of k words."""
    n = len(hashes) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * m + hashes[j : j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def word_hashes(text: bytes | None) -> np.ndarray:
    words = text.split() if text else []  # of bytes: splits at ASCII space and \\t to \\r alone
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds, and for each window of ``width`` words where its anchor stands: equal windows have equal anchors at equal
    places within them, and a text has an anchor every (width - SEED + 2) / 2 words on average."""
    seeds = _runs(hashes, SEED, _M1)
    n = len(hashes) - width + 1
    least, at = seeds[:n].copy(), np.arange(n)
    for j in range(1, width - SEED + 1):
        lower = seeds[j : j + n] < least
        least[lower] = seeds[j : j + n][lower]
        at[lower] = np.flatnonzero(lower) + j
    return seeds, at


def surroundings(hashes: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """For each seed a second hash of its words, then the words to the left, nearest first, then those to the right:
    as bytes, zero beyond the text's ends."""
    padded = np.concatenate([np.zeros(reach, np.uint64), hashes | np.uint64(1 << 16), np.zeros(reach, np.uint64)])
    step = np.arange(reach)
    near = np.concatenate([padded[at[:, None] + reach - 1 - step], padded[at[:, None] + reach + SEED + step]], axis=1)
    words = near.astype("<u8").view(np.uint8).reshape(len(at), 2 * reach, 8)[:, :, 8 - _BYTES :]
    second = _runs(hashes, SEED, _M2)[at].astype("<u8").view(np.uint8).reshape(len(at), 8)
    return np.concatenate([second, words.reshape(len(at), 2 * reach * _BYTES)], axis=1)


def extend(own: np.ndarray, other: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the seeds are the same words, and how many words before and after them are."""
    words = own[:, 8:].reshape(len(own), 2, reach, _BYTES)
    equal = (words == other[:, 8:].reshape(words.shape)).all(axis=3) & words.any(axis=3)
    found = np.minimum.accumulate(equal, axis=2).sum(axis=2)
    return (own[:, :8] == other[:, :8]).all(axis=1), found[:, 0], found[:, 1]


def window_keys(seeds: np.ndarray, near: np.ndarray, left: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for the windows with so many words left of their seed."""
    wide = np.zeros((len(near), 2 * reach, 8), np.uint8)
    wide[:, :, 8 - _BYTES :] = near[:, 8:].reshape(len(near), 2 * reach, _BYTES)
    words = wide.view("<u8").reshape(len(near), 2 * reach)
    a, b = seeds.copy(), near[:, :8].copy().view("<u8").reshape(-1)
    for column in (*range(left), *range(reach, 2 * reach - left)):
        a, b = a * _M1 + words[:, column], b * _M2 + words[:, column]
    salt = np.uint64(left + 1)
    return (a ^ (a >> np.uint64(29))) * _M2 + salt, (b ^ (b >> np.uint64(31))) * _M1 + salt


def _binary(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, the text's hash, which tells rows apart that share an id, and text as bytes."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))


def repeated_spans(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(copies, spans). copies: ids and keys of rows whose whole text is that of a smaller id. spans: for other rows
    (id, key, spans), runs of words (first, end) that also stand in a row with a smaller id; every window of ``width``
    words that does lies in one.

    Seed: rows are joined on the anchors that different ids share, each place with the one of the smallest id, never
    pairwise. Extend: the words around both places are compared to either side as far as a window with this anchor
    can reach; a match of ``width`` words or more is a repeat. What overlaps makes up a maximal repeat. Windows that
    differ from the smallest id's although their anchor is the same may still repeat among the rest: they are joined
    by 128-bit keys to their own smallest id. So a passage in many rows costs a row for each occurrence.
    """
    reach = width - SEED
    size = 8 + 2 * reach * _BYTES
    texts = _texts(docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()), id_col, text_col)
    row = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("key", T.LongType())]
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    marks = texts.select("id", "key", F.md5("text").alias("md5"))
    first = marks.groupBy("md5").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("md5", "least")
    copies = materialize(marks.join(first, "md5").where("id > least").select("id", "key").distinct())
    own = texts.join(sized(copies), ["id", "key"], "left_anti")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, at = [], []
            for i, t in enumerate(b.column(2)):
                h = word_hashes(t.as_py())
                if len(h) >= width:
                    s, where = anchors(h, width)
                    found.append(np.unique(s[where]))
                    at.append(np.full(len(found[-1]), i))
            if found:
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(found).view(np.int64))], names=["id", "key", "a"])

    each = own.mapInArrow(seeds, T.StructType(row + longs("a")))
    # written first: a join of two plain exchanges is one whose hot keys Spark splits
    shared = materialize(each.groupBy("a").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("a", "least"))
    mine = each.join(shared, "a").groupBy("id", "key")
    seeded = materialize(mine.agg(F.collect_set("a").alias("anchors"), F.collect_set(F.when(F.col("id") == F.col("least"), F.col("a"))).alias("led")))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, at = [], []
            for i, (t, wanted, led) in enumerate(zip(*b.columns[2:])):
                h = word_hashes(t.as_py())
                if len(h) < width:
                    continue
                s, where = anchors(h, width)
                spot, begin, n = np.unique(where, return_index=True, return_counts=True)
                most = spot - begin  # words left of the seed in the first of its windows
                keep = np.isin(s[spot], wanted.values.to_numpy().view(np.uint64))
                spot, most, n = spot[keep], most[keep], n[keep]
                lead = np.isin(s[spot], led.values.to_numpy().view(np.uint64))
                out.append((s[spot], spot, most - n + 1, most, lead, surroundings(h, spot, reach)))
                at.append(np.full(len(spot), i))
            if out:
                take = pa.array(np.concatenate(at))
                a, spot, low, high, lead, near = map(np.concatenate, zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(a.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (spot, low, high)), pa.array(lead), _binary(near)],
                    names=["id", "key", "a", "pos", "low", "high", "led", "near"],
                )

    schema = T.StructType(row + longs("a") + [T.StructField(n, T.IntegerType()) for n in ("pos", "low", "high")] + [T.StructField("led", T.BooleanType()), T.StructField("near", T.BinaryType())])
    some = own.join(sized(seeded.select("id", "key")), ["id", "key"], "left_semi").join(seeded.hint("merge"), ["id", "key"])
    met = materialize(some.select("id", "key", "text", "anchors", "led").mapInArrow(places, schema))
    heads = materialize(met.where("led").groupBy("a").agg(F.min(F.struct("id", "key", "pos", "near")).alias("head")))

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A match (with its end) or, with a key of two longs, a window that its anchor's head does not settle."""
        for b in batches:
            if not b.num_rows:
                continue
            a, pos, low, high = (b.column(i).to_numpy() for i in (2, 3, 4, 5))
            near = _bytes(b.column(6), size)
            same, left, right = extend(near, _bytes(b.column(7), size), reach)
            later = b.column(8).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(same & later & (left + right >= reach))
            take, begin, end = [hit], [(pos - left)[hit]], [(pos + SEED + right)[hit]]
            w1, w2 = [np.zeros(len(hit), np.int64)], [np.zeros(len(hit), np.int64)]
            for o in range(reach + 1):
                rest = np.flatnonzero((low <= o) & (o <= high) & ~(same & (o <= left) & (reach - o <= right)))
                x, y = window_keys(a[rest].view(np.uint64), near[rest], o, reach)
                take.append(rest)
                begin.append((pos - o)[rest])
                end.append(np.full(len(rest), -1))
                w1.append(x.view(np.int64))
                w2.append(y.view(np.int64))
            index = pa.array(np.concatenate(take))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(index), b.column(1).take(index), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (begin, end)), *(pa.array(np.concatenate(x)) for x in (w1, w2))],
                names=["id", "key", "first", "end", "w1", "w2"],
            )

    spans = T.StructType(row + [T.StructField(n, T.IntegerType()) for n in ("first", "end")] + longs("w1", "w2"))
    paired = met.join(heads, "a").select("id", "key", "a", "pos", "low", "high", "near", F.col("head.near").alias("other"), (F.col("id") > F.col("head.id")).alias("later"))
    found = materialize(paired.mapInArrow(matches, spans))
    open_ = found.where("end < 0")
    origin = open_.groupBy("w1", "w2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("w1", "w2", "least")
    late = open_.join(materialize(origin), ["w1", "w2"]).where("id > least").select("id", "key", "first", (F.col("first") + width).alias("end"))
    runs = found.where("end >= 0").select("id", "key", "first", "end").unionByName(late)
    return copies, materialize(runs.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("spans")))


def _cut(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, text, spans, copy of every row."""
    copies, spans = repeated_spans(docs, width, id_col, text_col)
    rows = _texts(docs, id_col, text_col)
    named = spans.select(F.col("id").alias("s_id"), F.col("key").alias("s_key"), "spans")
    rows = rows.join(sized(named, weight=F.size("spans")), (F.col("id") == F.col("s_id")) & (F.col("key") == F.col("s_key")), "left")
    twin = copies.select(F.col("id").alias("c_id"), F.col("key").alias("c_key"), F.lit(True).alias("copy"))
    rows = rows.join(sized(twin), (F.col("id") == F.col("c_id")) & (F.col("key") == F.col("c_key")), "left")
    return rows.select("id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Removes every word covered by a window of ``width`` words that also starts in a row with a smaller id.

    Words are what ASCII space and \\t to \\r separate. Windows are judged on the input.
    Columns: id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space), and with_text the kept
    words as kept_text. A null or empty text has no words. A row without an id keeps its words and removes none.
    Rows that share an id are not smaller than each other; each is judged by its own text. An empty table gives an
    empty result; extra columns are ignored. Words are compared by 48 bits each and seeds by 128, whole texts by MD5.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, digest, kept_text = [], [], [], []
            for text, spans, copy in zip(*b.columns[1:]):
                words = (text.as_py() or b"").split()
                n.append(len(words))
                kept = words
                if copy.as_py() and len(words) >= width:
                    kept = []
                elif spans.is_valid:
                    kept, at = [], 0
                    for i, j in zip(spans.values.field(0).to_pylist(), spans.values.field(1).to_pylist()):
                        kept += words[at:i]
                        at = max(at, j)
                    kept += words[at:]
                gone.append(len(words) - len(kept))
                joined = b" ".join(kept)
                digest.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    kept_text.append(joined)
            out = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out.append(pa.array(kept_text, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(out, names=names)

    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("kept_text", T.StringType())] * with_text)
    return _cut(docs, width, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
