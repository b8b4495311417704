"""Ranked lexical search: documents in a trie of frequency-ordered terms, searched by branch and bound for each item."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from lotwise.llm.common import ascii_lower, materialize

#: Java pattern of what separates terms.
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of the items that are searched together, on average; more items make more blocks, each with passes of its own.
BLOCK_TERMS = 8_192
#: A trie holds about so many documents, and terms of them, at most; a task builds one after the other.
TREE_DOCS, TREE_TERMS = 16_384, 2_000_000
#: Subtrees of at most so many documents are leaves.
LEAF = 16
#: In UTF-8, separators become a space and A-Z lower case; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_vectors(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of every document with a term: its length, and its vector restricted to the given terms."""
    shared = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for b in batches:
            rows, sizes, found, counts = [], [], [], []
            for i, text in enumerate(b.column(1)):
                words = text.as_py().translate(_FOLD).split(b" ") if text.is_valid else []
                seen = Counter(words)
                empty = seen.pop(b"", 0)
                if len(words) > empty:
                    own = [(number[t], n) for t, n in seen.items() if t in number]
                    rows.append(i)
                    sizes.append(len(words) - empty)
                    found.append([t for t, _ in own])
                    counts.append([n for _, n in own])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["id", "n", "terms", "tfs"]
            )

    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, T.StructType(fields))


def contribution(tf, m):
    """What a term adds to a score for each unit of its weight: grows with tf, falls with m."""
    return 1_000_000_000 * tf // (1_000 * tf + 20 * m)


class Trie:
    """Documents by their terms, the most frequent first: those that share a path lie side by side.

    Nodes cover a range of documents, and carry each term's largest tf and the least m below them. A node is a path
    of terms that all its documents share, then branches; small branches side by side are one leaf.
    """

    def __init__(self, ids: list, m: np.ndarray, start: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int):
        """Documents d with terms term[start[d]:start[d + 1]], ranked by frequency (0 the most frequent) and ascending."""
        big = term.astype(">u4")
        path = [big[a:b].tobytes() for a, b in zip(start[:-1], start[1:])]
        order = sorted(range(len(ids)), key=path.__getitem__)
        size = np.diff(start)[order]
        self.ids, self.m = [ids[d] for d in order], m[order]
        self.start = np.r_[0, np.cumsum(size)]
        at = np.arange(self.start[-1]) + np.repeat(start[:-1][order] - self.start[:-1], size)
        self.term, self.tf = term[at], tf[at].astype(np.int64)
        self.row = np.repeat(np.arange(len(ids)), size)
        self.span, self.below = [(0, len(ids))], [(0, 0)]  # of each node: its documents, its children
        padded, todo = np.r_[self.term, -1], [(0, 0)]
        while todo:
            node, depth = todo.pop()
            lo, hi = self.span[node]
            if hi - lo <= LEAF:
                continue
            shared = min(size[lo], size[hi - 1])
            first, last = self.term[self.start[lo] : self.start[lo] + shared], self.term[self.start[hi - 1] : self.start[hi - 1] + shared]
            depth = max(depth, int(np.argmin(np.r_[first == last, False])))
            own = self.start[lo:hi] + depth
            key = np.where(size[lo:hi] > depth, padded[np.minimum(own, len(self.term))], -1)
            cuts = [lo, *(lo + 1 + np.flatnonzero(np.diff(key))), hi]
            if len(cuts) == 2:  # equal paths
                continue
            parts: list[tuple[int, int, bool]] = []
            for a, b in zip(cuts, cuts[1:]):
                if parts and not parts[-1][2] and b - parts[-1][0] <= LEAF:
                    parts[-1] = (parts[-1][0], b, False)
                else:
                    parts.append((a, b, b - a > LEAF))
            self.below[node] = (len(self.span), len(self.span) + len(parts))
            for a, b, large in parts:
                if large:
                    todo.append((len(self.span), depth + 1))
                self.span.append((a, b))
                self.below.append((0, 0))
        self.most = np.zeros((len(self.span), n_terms), np.int32)
        self.least_m = np.zeros(len(self.span), np.int64)
        for node in range(len(self.span) - 1, -1, -1):  # children have higher numbers
            (lo, hi), (a, b) = self.span[node], self.below[node]
            self.least_m[node] = self.m[lo:hi].min() if lo < hi else 0
            if a < b:
                self.most[node] = self.most[a:b].max(axis=0)
            else:
                part = slice(self.start[lo], self.start[hi])
                np.maximum.at(self.most[node], self.term[part], self.tf[part])

    def search(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: list, k: int) -> int:
        """Adds to a heap of (score, descending id) what is among its k best; the number of documents looked at.

        Goes down the branches with the highest bound first, and not into those below the k-th score. ``dense`` has
        the weights of all terms, 0 for others.
        """
        looked, stack = 0, [(1 << 62, 0)]
        while stack:
            bound, node = stack.pop()
            if bound == 0 or len(best) == k and bound < best[0][0]:
                continue
            a, b = self.below[node]
            if a < b:
                bounds = (weights * contribution(self.most[a:b, terms].astype(np.int64), self.least_m[a:b, None])).sum(axis=1)
                stack.extend((int(bounds[i]), a + int(i)) for i in np.argsort(bounds, kind="stable"))
                continue
            lo, hi = self.span[node]
            looked += hi - lo
            part = slice(self.start[lo], self.start[hi])
            weight = dense[self.term[part]]
            hit = np.flatnonzero(weight)
            row = self.row[part][hit]
            score = np.zeros(hi - lo, np.int64)
            np.add.at(score, row - lo, weight[hit] * contribution(self.tf[part][hit], self.m[row]))
            for d in np.flatnonzero(score >= max(best[0][0] if len(best) == k else 1, 1)):
                entry = (int(score[d]), _Descending(self.ids[lo + d]))
                (heapq.heappush if len(best) < k else heapq.heappushpop)(best, entry)
        return looked


class _Descending:
    """An id that counts as less than smaller ones; null as the largest id."""

    __slots__ = ("id",)

    def __init__(self, id):
        self.id = id

    def __lt__(self, other):
        return other.id is not None and (self.id is None or self.id > other.id)


def _best(vectors: DataFrame, items: list[tuple], weights: np.ndarray, rank: np.ndarray, n_docs: int, n_terms: int, k: int, item_type: T.DataType) -> DataFrame:
    """The k best documents of each task for each item."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, weights, rank))  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, rank = shared.value
        by_rank = np.zeros(len(rank), np.int64)
        by_rank[rank] = weights
        wanted = [np.sort(rank[[t for t in terms if weights[t] > 0]]) for _, terms in items]
        best: list[list] = [[] for _ in items]

        def flush(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts)
            size = rows["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            term = rank[rows["terms"].combine_chunks().flatten().to_numpy()]
            tf = rows["tfs"].combine_chunks().flatten().to_numpy()
            start = np.r_[0, np.cumsum(size)]
            by = np.lexsort((term, np.repeat(np.arange(len(size)), size)))
            n = rows["n"].to_numpy()
            trie = Trie(rows["id"].to_pylist(), 50 + 50 * n * n_docs // n_terms, start, term[by], tf[by], len(rank))
            dense = np.zeros(len(rank), np.int64)
            for terms, heap in zip(wanted, best):
                if len(terms):
                    dense[terms] = by_rank[terms]
                    trie.search(terms, by_rank[terms], dense, heap, k)
                    dense[terms] = 0

        parts, held, held_terms = [], 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                b = batch.slice(i, 1024)
                parts.append(b)
                held += b.num_rows
                held_terms += len(b.column(2).flatten())
                if held >= TREE_DOCS or held_terms >= TREE_TERMS:
                    flush(parts)
                    parts, held, held_terms = [], 0, 0
        if held:
            flush(parts)
        out = [(item, e[1].id, e[0]) for (item, _), heap in zip(items, best) for e in heap]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa_item), pa.array([x[1] for x in out], pa_id), pa.array([x[2] for x in out], pa.int64())], names=["item", "id", "score"])

    id_type = vectors.schema["id"].dataType
    pa_item, pa_id = to_arrow_type(item_type), to_arrow_type(id_type)
    return vectors.mapInArrow(run, T.StructType([T.StructField("item", item_type), T.StructField("id", id_type), T.StructField("score", T.LongType())]))


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Ranks all documents for each item and returns its k best with a score above 0.

    Terms are runs of digits, letters and anything beyond ASCII of the whole text, only A-Z lower-cased. With N the
    documents that have a term, L their terms, n one document's, df the documents with a term and tf its occurrences,
    a term weighs floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is 50 + 50 n N div L, and its score sums
    weight * (10^9 tf div (1000 tf + 20 m)) over the item's terms, once each.

    Documents become vectors of the items' terms. A task puts its documents into tries, the most frequent term first,
    whose nodes bound the scores below them; branches that cannot reach an item's k best so far are left out. No
    document is left out otherwise, so ranks are exact. Items are taken in blocks of about BLOCK_TERMS terms.

    Columns: item, rank (from 1), id, score; equal scores by ascending id, null last. Null and empty texts have no terms.
    Items that share an id are one item with the terms of all; an item without terms, or whose terms no document has,
    gives no rows. Repeated documents each take a rank. Empty tables give an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item"), F.explode(F.array_distinct(F.split(ascii_lower(F.coalesce(F.col(item_text_col), F.lit(""))), NO_TERM))).alias("term"))
    asked = materialize(asked.where("term <> ''").distinct())
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    found = None
    for block in range(blocks):
        own: dict = {}
        number: dict[str, int] = {}
        for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item", "term").collect():
            own.setdefault(r["item"], []).append(number.setdefault(r["term"], len(number)))
        vectors = materialize(term_vectors(docs, list(number), id_col, text_col))
        n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(number), np.int64)
        for term, n in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
        rank = np.empty(len(number), np.int64)
        rank[np.argsort(-df, kind="stable")] = np.arange(len(number))
        part = materialize(_best(vectors, list(own.items()), weights, rank, n_docs, n_terms or 1, k, asked.schema["item"].dataType))
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    out = found.withColumn("rank", place).where(F.col("rank") <= k)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
