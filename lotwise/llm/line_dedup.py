"""Line dedup: lines that many documents hold, found in one range-partitioned order of hashes, dropped by bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lotwise.llm.common import ascii_lower, materialize, sized

#: What is stripped at both ends of a line.
BLANKS = " \t\n\x0b\f\r"
#: Index of the last line of any text, and beyond.
END = 2**31 - 1


def text_lines(text: Column) -> Column:
    """The lines of a text, apart by \\n; one empty line for null."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, t1, t2): rows that share an id are told apart by 128 bits of their text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What to keep of the documents that lose lines: no texts, only bitmaps in run-length form.

    A line's key is the line without blanks at both ends and with A-Z in lower case. Keys of at least ``least_chars``
    code points that at least ``least_docs`` documents hold lose all their lines but those of the largest id.

    Keys become 128-bit hashes. Those are range-partitioned together with the document, so that a key of any size
    spreads over many tasks, and sorted by document and position; one pass over that order marks the first occurrence
    of a key in each document. Only these are counted for each key, partly before they are shuffled.

    Columns: id, t1, t2 (hashes of the text), n_dropped, keep (array of first and last index of each run of kept lines;
    the last run of a text ends at END or at a dropped line). Documents that lose nothing have no row.
    Null texts count as empty. Rows without an id count as one document, smaller than any other. Rows that share an
    id are one document too; each of their texts has a bitmap. Repeated rows share one. An empty table gives none.
    """
    lines = _own(docs, id_col, text_col).select("id", "t1", "t2", F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("id", "t1", "t2", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")).where(F.length("line") >= least_chars)
    lines = lines.select("id", "t1", "t2", "pos", ascii_lower(F.col("line")).alias("key")).select("id", "t1", "t2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    held = ["h1", "h2", "id"]
    order = materialize(lines).repartitionByRange(*held).withColumn("first", F.row_number().over(Window.partitionBy(*held).orderBy("pos", "t1", "t2")) == 1)
    order = materialize(order)
    common = order.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("stays")).where(F.col("n") >= least_docs).select("h1", "h2", "stays")
    gone = order.join(sized(materialize(common)), ["h1", "h2"]).where(F.coalesce(F.col("id") < F.col("stays"), F.lit(True)))
    gone = gone.groupBy("id", "t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("gone")),
        lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.get("gone", i - 1) + 1).alias("first"),
            F.when(i == F.size("gone"), END).otherwise(F.get("gone", i) - 1).alias("last"),
        ),
    )
    return gone.select("id", "t1", "t2", F.size("gone").cast("long").alias("n_dropped"), F.filter(runs, lambda r: r["first"] <= r["last"]).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The kept lines of a text, joined; the text itself where there is no bitmap."""
    lines = text_lines(text)
    parts = F.transform(keep, lambda r: F.slice(lines, r["first"] + 1, F.greatest(F.least(r["last"], F.size(lines) - 1) - r["first"] + 1, F.lit(0))))
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.flatten(parts), "\n"))


def deduplicated(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_lines, n_dropped, kept) of every row: bitmaps meet the texts, by broadcast as long as they are few."""
    bitmaps = materialize(keep_bitmaps(docs, least_chars, least_docs, id_col, text_col))
    bitmaps = sized(bitmaps, weight=F.size("keep")).withColumnsRenamed({"id": "b_id", "t1": "b1", "t2": "b2"})
    rows = _own(docs, id_col, text_col)
    rows = rows.join(bitmaps, rows["id"].eqNullSafe(bitmaps["b_id"]) & (rows["t1"] == bitmaps["b1"]) & (rows["t2"] == bitmaps["b2"]), "left")
    return rows.select("id", "text", F.size(text_lines(F.col("text"))).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), kept_text(F.col("text"), F.col("keep")).alias("kept"))


def line_report(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_lines, n_dropped, kept_sha256: what keep_bitmaps leaves of every row.

    A null or empty text is one empty line, which stays. Every row gives a row, repeated ones too; rows that share an
    id are judged by their own text. An empty table gives an empty result; extra columns are ignored.
    """
    rows = deduplicated(docs, least_chars, least_docs, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
