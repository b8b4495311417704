"""An index for text searches: grams to values, values to rows, rows in source order. A search reads what it names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lotwise.operators.search import SEARCHED

GRAM = 3
#: A search intersects at most so many grams of its text: as many as a Parquet scan takes as exact values. Hits are verified.
GRAMS = 10
#: Up to so many keys are looked up by ranges pushed into the scan; more are joined.
LOOKUP = 2_000
#: Keys are gathered into at most so many ranges.
RANGES = 64
#: Rows and values are listed in blocks of 2 to this power, so that no list grows with the table.
BLOCK_BITS = 16
#: Rows of a page of the indexed records: the least that a lookup reads.
PAGE_ROWS = 1_024


@dataclass
class Index:
    """Tables of an index. records: as given, with _row, ascending in source order; values: vid, text; grams: gram, values
    (sorted lists of vid); rows: vid, block, rows (sorted lists of places in the block)."""

    records: DataFrame
    values: DataFrame
    grams: DataFrame
    rows: DataFrame


def _write(df: DataFrame, path: str) -> None:
    df.write.option("parquet.page.row.count.limit", PAGE_ROWS).mode("overwrite").parquet(path)


def grams_of(text: Column | str) -> Column:
    """The distinct grams of a text; none of a shorter one."""
    c = F.col(text) if isinstance(text, str) else text
    at = F.when(F.length(c) >= GRAM, F.sequence(F.lit(1), F.length(c) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(c, i, GRAM)))


def build(records: DataFrame, folder: str, columns: Sequence[str] = tuple(SEARCHED), order: str = "_source_row") -> Index:
    """Writes an index of some columns, in lower case, and opens it.

    Texts repeat, so grams are taken once for each distinct value, and rows are listed for values. A value of any number
    of rows is listed block by block. Null is the empty text. The records are written in source order, in small pages.
    """
    spark = records.sparkSession
    _write(records.repartitionByRange(order).sortWithinPartitions(order).withColumn("_row", F.monotonically_increasing_id()), f"{folder}/records")
    texts = F.explode(F.array_distinct(F.array(*(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))))
    held = spark.read.parquet(f"{folder}/records").select("_row", texts.alias("text")).where("text <> ''")
    place = F.col("_row").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    lists = held.groupBy("text", F.shiftright("_row", BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_list(place)).alias("rows"))
    lists.write.mode("overwrite").parquet(f"{folder}/lists")
    lists = spark.read.parquet(f"{folder}/lists")
    values = lists.select("text").distinct().repartitionByRange("text").sortWithinPartitions("text").select(F.monotonically_increasing_id().alias("vid"), "text")
    _write(values, f"{folder}/values")
    values = spark.read.parquet(f"{folder}/values")
    grams = values.select("vid", F.explode(grams_of("text")).alias("gram")).groupBy("gram", F.shiftright("vid", BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_list("vid")).alias("values"))
    _write(grams.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block"), f"{folder}/grams")
    _write(lists.join(values, "text").select("vid", "block", "rows").repartitionByRange("vid", "block").sortWithinPartitions("vid", "block"), f"{folder}/rows")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/lists")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{name}") for name in ("records", "values", "grams", "rows")))


def ranges(keys: Sequence[int]) -> list[tuple[int, int]]:
    """Sorted keys as at most RANGES ranges, cut where the gaps between them are widest."""
    cuts = sorted(sorted(range(1, len(keys)), key=lambda i: keys[i - 1] - keys[i])[: RANGES - 1])
    return [(keys[a], keys[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(keys)])] if keys else []


def among(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of a table, sorted by a key, whose keys are given: few are pushed into the scan as ranges, which leaves out
    all pages without one; many are joined."""
    found = sorted({r[0] for r in keys.limit(LOOKUP + 1).collect()})
    if len(found) > LOOKUP:
        return table.join(keys.distinct(), key, "left_semi")
    if not found:
        return table.where("false")
    return table.where(reduce(or_, (F.col(key).between(a, b) for a, b in ranges(found)))).where(F.col(key).isin(found))


def matching_rows(index: Index, text: str) -> DataFrame:
    """The _row of every record of which some column holds a text, whatever the case; each once.

    Values that have all of the text's grams are verified. A text shorter than a gram is looked for in all values, which
    are fewer than records; the empty text is in all records.
    """
    text = text.strip().lower()
    if not text:
        return index.records.select("_row")
    if len(text) < GRAM:
        hits = index.values.where(F.col("text").contains(text))
    else:
        every = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
        some = every[:: -(-len(every) // GRAMS)]
        having = index.grams.where(F.col("gram").isin(some)).select(F.explode("values").alias("vid")).groupBy("vid").agg(F.count("*").alias("n")).where(F.col("n") == len(some))
        hits = among(index.values, "vid", having.select("vid")).where(F.col("text").contains(text))
    return among(index.rows, "vid", hits.select("vid")).select("block", F.explode("rows").alias("place")).select((F.shiftleft("block", BLOCK_BITS) + F.col("place")).alias("_row")).distinct()


def filtered(index: Index, search: str = "", **equal: str | None) -> DataFrame:
    """Records that hold a text and equal every given column, as search.filtered gives them, by the index."""
    rows = among(index.records, "_row", matching_rows(index, search)) if search.strip() else index.records
    for column, value in equal.items():
        if value:
            rows = rows.where(F.col(column) == value)
    return rows.drop("_row")


def find(index: Index, text: str, limit: int = 20) -> DataFrame:
    """The first records, in source order, that hold a text, with how many do in all. Counted and chosen on row numbers;
    only the chosen records are read."""
    rows = matching_rows(index, text)
    n = rows.count()
    first = among(index.records, "_row", rows.orderBy("_row").limit(limit))
    return first.drop("_row").withColumn("matches", F.lit(n).cast("long"))
