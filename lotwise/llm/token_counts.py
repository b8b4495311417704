"""Token counts: an exact histogram of encoded lengths and its suffix sums."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lotwise.llm.common import materialize

#: Lengths are summed in chunks of so many, so that no task holds the whole histogram.
CHUNK = 1024
#: How a text falls into pieces before they are encoded, unless another pattern is given.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Runs of white space (by Unicode's property, as the encoder's patterns have it) that the encoder need not see whole.
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")


def token_count(encoder, text: str) -> int:
    """The number of tokens of a text.

    The encoder's pattern engine overflows its stack on a run of hundreds of thousands of blanks. Under PATTERN such a
    run is one piece, but for its last blank where text follows, and no piece before it reaches into it; so long runs
    are encoded as pieces of their own, with the same result.
    """
    n = at = 0
    if encoder._pat_str == PATTERN:
        for m in _LONG_SPACE.finditer(text):
            end = m.end() - (m.end() < len(text))
            n += len(encoder.encode_ordinary(text[at : m.start()])) + len(encoder._encode_single_piece(text[m.start() : end]))
            at = end
    return n + len(encoder.encode_ordinary(text[at:]))


def vocabulary(path: str) -> bytes:
    """A rank file: lines of base64 token and rank. It has a fixed size (about a MB), so tasks get it by broadcast."""
    with open(path, "rb") as f:
        return f.read()


def lengths(docs: DataFrame, ranks: bytes, pattern: str = PATTERN, text_col: str = "text") -> DataFrame:
    """The number of tokens of every text, one row each; 0 for null."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([token_count(encoder, t.as_py() or "") for t in b.column(0)], pa.int64())], names=["length"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "length long")


def length_histogram(docs: DataFrame, ranks: bytes, pattern: str = PATTERN, text_col: str = "text") -> DataFrame:
    """Documents by encoded length, with what suffix sums answer at every length that occurs.

    Columns: length, n_docs, n_longer (documents of at least this length), tokens_longer (their tokens), n_total,
    tokens_total, truncated_total (tokens if every document is cut to this length), quantile (share of documents of
    at most this length). ``at_limits`` reads the answers for limits that do not occur. A null or empty text has length
    0. Repeated rows count each. An empty table gives an empty result; extra columns are ignored.

    A histogram has fewer rows than the root of twice the corpus's tokens. Its suffix sums are taken within chunks
    of lengths and over the chunks, so that no window holds all of it.
    """
    counts = materialize(lengths(docs, ranks, pattern, text_col).groupBy("length").agg(F.count("*").alias("n_docs")))
    cells = counts.withColumn("chunk", F.floor(F.col("length") / CHUNK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    chunks = cells.groupBy("chunk").agg(F.sum("n_docs").alias("n"), F.sum("tokens").alias("k"))
    after, whole = W.orderBy("chunk").rowsBetween(1, W.unboundedFollowing), W.orderBy("chunk").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    chunks = chunks.select("chunk", F.coalesce(F.sum("n").over(after), F.lit(0)).alias("n_after"), F.coalesce(F.sum("k").over(after), F.lit(0)).alias("k_after"), F.sum("n").over(whole).alias("n_total"), F.sum("k").over(whole).alias("tokens_total"))
    here = W.partitionBy("chunk").orderBy("length").rowsBetween(0, W.unboundedFollowing)
    out = cells.join(chunks, "chunk").withColumn("n_longer", F.sum("n_docs").over(here) + F.col("n_after")).withColumn("tokens_longer", F.sum("tokens").over(here) + F.col("k_after"))
    return out.select(
        "length",
        "n_docs",
        "n_longer",
        "tokens_longer",
        "n_total",
        "tokens_total",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("length") * F.col("n_longer")).alias("truncated_total"),
        ((F.col("n_total") - F.col("n_longer") + F.col("n_docs")) / F.col("n_total")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for given context limits: limit, n_cut (documents longer than it), truncated_total.

    Read from the suffix sums at the least length beyond each limit; beyond the longest text nothing is cut. An empty
    histogram gives zeros.
    """
    beyond = lambda x: F.min_by(F.struct("n_longer", "tokens_longer"), F.when(F.col("length") > x, F.col("length")))
    found = histogram.agg(F.coalesce(F.max("tokens_total"), F.lit(0)).alias("tokens"), *(beyond(x).alias(f"at_{i}") for i, x in enumerate(limits)))
    answers = F.array(*(F.struct(F.lit(x).cast("long").alias("limit"), F.col(f"at_{i}").alias("at")) for i, x in enumerate(limits)))
    n, k = F.coalesce("a.at.n_longer", F.lit(0)), F.coalesce("a.at.tokens_longer", F.lit(0))
    return found.select("tokens", F.explode(answers).alias("a")).select("a.limit", n.alias("n_cut"), (F.col("tokens") - k + F.col("a.limit") * n).alias("truncated_total"))


def at_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share the least length that so many of the documents do not exceed: share, length (null if empty)."""
    found = histogram.agg(*(F.min(F.when(F.col("quantile") >= q, F.col("length"))).alias(f"at_{i}") for i, q in enumerate(shares)))
    return found.select(F.explode(F.array(*(F.struct(F.lit(float(q)).alias("share"), F.col(f"at_{i}").alias("length")) for i, q in enumerate(shares)))).alias("a")).select("a.*")
