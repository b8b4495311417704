"""A table in sort order with an index of places and bloom filters: pages and lookups read what they show."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

#: Rows of a Parquet page: the least that a page of rows reads.
PAGE_ROWS = 1_024
#: Bytes of a row group: a bloom filter tells for one whether it may have a value.
GROUP_BYTES = 16 << 20
_PART_BITS = 33  # of monotonically_increasing_id


def sort_keys(df: DataFrame, column: str, descending: bool = True) -> list[Column]:
    """How a list is sorted by a column of any type: numbers and times by value, texts without regard to case first, null
    like the empty text or below all numbers. Rows that tie keep the order of what follows."""
    kind = df.schema[column].dataType
    text = isinstance(kind, T.StringType)
    keys = [F.lower(F.coalesce(column, F.lit(""))), F.coalesce(column, F.lit(""))] if text else [F.col(column)]
    return [(k.desc_nulls_last() if descending else k.asc_nulls_first()) for k in keys]


def write(df: DataFrame, folder: str, order: Sequence[Column | str], group: Sequence[str] = (), blooms: Sequence[str] = (), values: int = 1_000_000, group_bytes: int = GROUP_BYTES) -> None:
    """Writes a table sorted by group columns and a total order, in small pages, with bloom filters on some columns, and an
    index of where each group's rows are in each file: a row for each group and file."""
    by = [*group, *order]
    w = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_pos", F.monotonically_increasing_id()).write.mode("overwrite")
    w = w.option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.block.size", group_bytes)
    for c in blooms:  # a column with few values is kept as a dictionary, which tells the same
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", values)
    w.parquet(f"{folder}/rows")
    rows = df.sparkSession.read.parquet(f"{folder}/rows")
    index = rows.groupBy(*group, F.shiftright("_pos", _PART_BITS).alias("part")).agg(F.min("_pos").alias("first"), F.count("*").alias("n"))
    index.write.mode("overwrite").parquet(f"{folder}/index")


def _own(df: DataFrame, group: dict[str, str]) -> DataFrame:
    return df.where(reduce(and_, (F.col(c) == v for c, v in group.items()), F.lit(True)))


def count(spark: SparkSession, folder: str, **group: str) -> int:
    """How many rows a group has, from the index."""
    return _own(spark.read.parquet(f"{folder}/index"), group).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def page(spark: SparkSession, folder: str, offset: int, limit: int, **group: str) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a group (all group columns given, or none for the whole table), in order.

    The index gives the places of these rows; only their pages are read, however deep they are.
    """
    index = _own(spark.read.parquet(f"{folder}/index"), group)
    parts = index.groupBy("part").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    start = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row for each file
    near = parts.withColumn("start", F.coalesce(start, F.lit(0))).where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset))
    places = [(r["first"] + max(0, offset - r["start"]), r["first"] + min(r["n"], offset + limit - r["start"]) - 1) for r in near.collect()]
    rows = spark.read.parquet(f"{folder}/rows")
    own = rows.where(reduce(or_, (F.col("_pos").between(a, b) for a, b in places))) if places else rows.where("false")
    return own.orderBy("_pos").drop("_pos")


def lookup(spark: SparkSession, folder: str, **equal: str) -> DataFrame:
    """The rows that equal the given columns; row groups whose bloom filters rule a value out are not read."""
    return _own(spark.read.parquet(f"{folder}/rows"), equal).drop("_pos")
