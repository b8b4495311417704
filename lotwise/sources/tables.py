"""Dataset tables: partitioned writes, lookups, deletes, and intermediate tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Child tables of a dataset.
CHILDREN = ["records", "brands", "categories", "subcategories", "families", "variants", "warehouses", "suggestions", "issues", "excluded"]
_own: dict[str, str] = {}  # temporary folders of local applications


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a local session may go without and gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _own[app] = tempfile.mkdtemp(prefix="spark-lotwise-")
        base = _own[app]
    return base.rstrip("/")


def shared_table(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again."""
    path = f"{own_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_tables(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


def delete_tables(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application, once the results that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that are broadcast at most; pairs of numbers that are.
MOST_ROWS, MOST_PAIRS = 200_000, 2_000_000


def sized(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Hints a broadcast of a written, narrow table if it has few enough rows; else leaves a join that shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def once_for_each(records: DataFrame, keys: list[str], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Records with the columns that ``judge`` adds to their keys, which it sees once for each distinct combination.

    For costly rules over texts that repeat. The combinations are pre-aggregated where the records lie; their results
    are written and joined back, broadcast while they are few. More combinations of few values are broadcast as numbers.
    """
    judged = judge(records.select(*keys).distinct())
    added = [c for c in judged.columns if c not in keys]
    named = shared_table(judged.select(*(F.col(k).alias(f"__key_{k}") for k in keys), *added))
    if MOST_ROWS < named.limit(MOST_PAIRS + 1).count() <= MOST_PAIRS and (found := _by_numbers(records, named, keys, added)) is not None:
        return found
    return records.join(sized(named), _same(keys), "left").drop(*(f"__key_{k}" for k in keys))


def _same(keys: Sequence[str]) -> Column:
    return reduce(and_, (F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys))


def _numbered(values: DataFrame, number: str) -> DataFrame | None:
    """Distinct rows with numbers from 0, written; None if there are more than are broadcast."""
    values = values.distinct().limit(MOST_ROWS + 1)
    n = values.count()
    return shared_table(values.coalesce(1).withColumn(number, F.monotonically_increasing_id())) if n <= MOST_ROWS else None


def _by_numbers(records: DataFrame, named: DataFrame, keys: list[str], added: list[str]) -> DataFrame | None:
    """Records with what is named for their keys, where combinations are many and values and answers few: each key column's
    values and the answers get numbers, and what is broadcast of a combination is two numbers. None if that does not fit."""
    lists = {k: _numbered(named.select(f"__key_{k}"), f"__at_{k}") for k in keys}
    answers = _numbered(named.select(*(F.col(c).alias(f"__key_{c}") for c in added)), "__answer")
    if answers is None or any(x is None for x in lists.values()):
        return None
    place, size = F.lit(0).cast("long"), 1
    for k in keys:
        place, size = place + F.col(f"__at_{k}") * size, size * max(lists[k].count(), 1)
    if size >= 1 << 62:
        return None
    pairs = named.join(F.broadcast(answers), _same(added))
    for k in keys:
        pairs = pairs.withColumnRenamed(f"__key_{k}", k).join(F.broadcast(lists[k]), _same([k]))
        records = records.join(F.broadcast(lists[k]), _same([k]), "left").drop(f"__key_{k}")
    pairs = shared_table(pairs.select(place.alias("__place"), F.col("__answer")))
    records = records.withColumn("__own", place).join(F.broadcast(pairs), F.col("__own") == F.col("__place"), "left").drop("__own", "__place", *(f"__at_{k}" for k in keys))
    answers = answers.select(F.col("__answer").alias("__number"), *(F.col(f"__key_{c}").alias(c) for c in added))
    return records.join(F.broadcast(answers), F.col("__answer") == F.col("__number"), "left").drop("__answer", "__number")


def once_for_all(records: DataFrame, judges: Sequence[tuple[list[str], Callable[[DataFrame], DataFrame]]], most: int = MOST_ROWS) -> DataFrame:
    """Records with the columns that several judges add to their keys, as once_for_each: the distinct combinations of all
    judges' keys are found in one pass over the records. A judge with few of them is asked once for each and its answers
    are broadcast; one with more judges the records themselves, which needs no shuffle.
    """
    if not judges:
        return records
    keys = list(dict.fromkeys(k for own, _ in judges for k in own))
    number = lambda own: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in own)
    seen = shared_table(records.groupingSets([own for own, _ in judges], *keys).agg(F.grouping_id().alias("__set")))
    found = {r[0]: r[1] for r in seen.groupBy("__set").count().collect()}  # a row for each judge
    for own, judge in judges:
        if found.get(number(own), 0) > most:
            records = judge(records)
            continue
        judged = judge(seen.where(F.col("__set") == number(own)).select(*own))
        named = judged.select(*(F.col(k).alias(f"__key_{k}") for k in own), *(c for c in judged.columns if c not in own))
        records = records.join(F.broadcast(named), _same(own), "left").drop(*(f"__key_{k}" for k in own))
    return records


def with_id(records: DataFrame) -> DataFrame:
    """A stable id for every raw row, from where it stood."""
    return records.withColumn("id", F.sha2(F.concat_ws("|", "dataset_id", "_sheet_name", F.col("_source_row").cast("string")), 256))


def save(df: DataFrame, folder: str, name: str) -> None:
    """Replaces the partitions of the datasets that the frame holds, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, name: str, dataset_id: str | None = None) -> DataFrame:
    """A table, or one dataset's partition of it."""
    df = spark.read.parquet(f"{folder}/{name}")
    return df if dataset_id is None else df.where(F.col("dataset_id") == dataset_id)


def page(df: DataFrame, where: Column | None, order: list[Column | str], offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the rows that satisfy a condition; the order should be total."""
    return (df if where is None else df.where(where)).orderBy(*order).offset(offset).limit(limit)


def without_dataset(df: DataFrame, deleted: DataFrame) -> DataFrame:
    """What is left of a table when datasets (dataset_id) are deleted."""
    return df.join(sized(deleted.select("dataset_id").distinct()), "dataset_id", "left_anti")


def save_dataset(spark: SparkSession, folder: str, dataset_id: str, name: str, uploaded_at: str, children: dict[str, DataFrame]) -> None:
    """Replaces a dataset: its child tables, and last its own row, so that a listed dataset is whole. Rows of other
    datasets in the given tables are left out; children that are not given become empty.

    Everything is written aside first and then moved into place, so a job that fails leaves the dataset as it was.
    """
    if unknown := set(children) - set(CHILDREN):
        raise ValueError(f"no child tables {sorted(unknown)}")
    aside = f"{folder}/_new/{uuid.uuid4().hex}"
    for child, df in children.items():
        own = df.where(F.col("dataset_id") == dataset_id) if "dataset_id" in df.columns else df.withColumn("dataset_id", F.lit(dataset_id))
        save(own, aside, child)
    row = spark.createDataFrame([(dataset_id, name)], "dataset_id string, name string").withColumn("uploaded_at", F.lit(uploaded_at).cast("timestamp"))
    save(row, aside, "datasets")
    delete_dataset(spark, folder, dataset_id)
    for table in [*children, "datasets"]:
        old, new = (_partition(spark, at, table, dataset_id) for at in (folder, aside))
        fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(new):  # a child without rows has none
            fs.mkdirs(old.getParent())
            fs.rename(new, old)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), True)


def _partition(spark: SparkSession, folder: str, table: str, dataset_id: str):
    """The path of a dataset's partition, spelt as Spark spells it."""
    spelt = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(dataset_id)
    return spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}", f"dataset_id={spelt}")


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    """The datasets, newest first, then by id."""
    return load(spark, folder, "datasets").orderBy(F.col("uploaded_at").desc(), "dataset_id")


def delete_dataset(spark: SparkSession, folder: str, dataset_id: str, names: list[str] | None = None) -> None:
    """Drops one dataset's partition from the list of datasets and from every child table, through Spark's own file
    system."""
    for name in names or ["datasets", *CHILDREN]:
        path = _partition(spark, folder, name, dataset_id)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            fs.delete(path, True)


def manifest(files: DataFrame, most_mb: int = 100) -> DataFrame:
    """From a binaryFile scan: path, length, sha256, admitted, reason, duplicate of an earlier admitted path.

    Spreadsheets and CSV files of 1 byte to ``most_mb`` megabytes are admitted. Only their contents are read and hashed:
    length filters are pushed into the scan, so a refused file of any size costs nothing.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.coalesce(F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)), F.lit(""))
    safe = F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_").alias("safe_name")
    fits, known = (F.col("length") > 0) & (F.col("length") <= most_mb << 20), ext.isin("xlsx", "xls", "csv")
    reason = F.when(~known, "unsupported type").when(F.col("length") == 0, "empty").otherwise("too large")
    taken = files.where(fits & known).select("path", "length", F.sha2("content", 256).alias("sha256"), F.lit(True).alias("admitted"), F.lit(None).cast("string").alias("reason"), safe)
    refused = files.where(~(fits & known)).select("path", "length", F.lit(None).cast("string").alias("sha256"), F.lit(False).alias("admitted"), reason.alias("reason"), safe)
    taken = shared_table(taken)
    first = taken.groupBy("sha256").agg(F.min("path").alias("first_path"))
    found = taken.join(first, "sha256").withColumn("is_duplicate", F.col("path") != F.col("first_path"))
    return found.unionByName(refused.withColumns({"first_path": F.lit(None).cast("string"), "is_duplicate": F.lit(False)}))
