"""Helpers shared by the corpus operators: word splitting, shared scratch tables, size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Java pattern of what separates words.
SPACES = r"[\x20\x09-\x0D]+"
#: Java pattern of one word.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast up to so many narrow rows (under 100 MB built); beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def spaced(text: Column) -> Column:
    """The text with every separator of words turned into one space; empty for null."""
    text = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r":  # plain replacements and a split at one character are much cheaper than a pattern
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(spaced(text), " "), "")


def number_array(values, kind: str) -> Column:
    """A constant array of a bounded number of numbers, folded into one literal when the query is optimised."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)")


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and leaves every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of the frame has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_own: dict[str, str] = {}  # temporary folders of local applications


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the driver and all executors see: spark.checkpoint.dir.

    Only a local session may go without that setting; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _own[app] = tempfile.mkdtemp(prefix="spark-lotwise-")
        base = _own[app]
    return base.rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    note(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def note(path: str) -> None:
    """Leaves a table to the scratch around, if there is one, to be deleted."""
    if (made := _made.get()) is not None:
        made.append(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables that are materialised within it once it ends, but for those taken out of the list."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "2m") -> Iterator[None]:
    """Within it Spark hands rows to Python in batches of so many bytes at most (10,000 rows of any width by default),
    so that a worker and the buffers that feed it hold a few of these and not tens of MB each."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def sized(df: DataFrame, most: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """Hints a broadcast of a materialised, narrow table if it has few enough rows; else leaves a shuffle join.

    Rows that hold arrays count as so many rows as ``weight`` says."""
    if weight is None:
        small = df.limit(most + 1).count() <= most
    else:
        small = (df.agg(F.sum(F.lit(1) + weight)).first()[0] or 0) <= most
    return F.broadcast(df) if small else df.hint("merge")
