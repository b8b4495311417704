"""Pages, lookups and sort orders, and how much of a table they read."""

import random

from pyspark.sql import functions as F

from lotwise.operators import rollups
from lotwise.plans.queries import categorized
from lotwise.sources import exports, layout
from tests.test_search_index import scanned

SF = "/root/testdata/sf0.001"


def test_pages_and_lookups(spark, tmp_path):
    n = 60_000
    df = spark.range(n).select(F.concat(F.lit("d"), F.pmod(F.xxhash64("id"), F.lit(3))).alias("dataset_id"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)).alias("key"), "id", F.sha1(F.col("id").cast("string")).alias("item_id"))
    folder = str(tmp_path / "t")
    layout.write(df, folder, ["key", "id"], ["dataset_id"], ["item_id"], group_bytes=128 << 10)
    for d in ("d0", "d1", "d2", "none"):
        own = [r.id for r in df.where(F.col("dataset_id") == d).orderBy("key", "id").collect()]
        assert layout.count(spark, folder, dataset_id=d) == len(own)
        for offset, limit in ((0, 50), (9_990, 50), (len(own) - 3, 10), (len(own), 5), (500, 15_000), (0, 0)):
            got = layout.page(spark, folder, offset, limit, dataset_id=d)
            assert [r.id for r in got.collect()] == own[offset : offset + limit]
    everything = [r.id for r in df.orderBy("dataset_id", "key", "id").collect()]
    assert [r.id for r in layout.page(spark, folder, 25_000, 100).collect()] == everything[25_000:25_100]
    deep = layout.page(spark, folder, 15_000, 50, dataset_id="d1")
    assert scanned(deep) <= 4 * layout.PAGE_ROWS
    wanted = df.where("id = 777").first()
    found = layout.lookup(spark, folder, item_id=wanted.item_id)
    assert [r.id for r in found.collect()] == [777] and scanned(found) < n / 3
    assert layout.lookup(spark, folder, item_id=wanted.item_id, dataset_id="none").count() == 0
    layout.write(df.where("false"), str(tmp_path / "e"), ["key"], ["dataset_id"])
    assert layout.page(spark, str(tmp_path / "e"), 0, 5, dataset_id="d1").count() == 0 and layout.count(spark, str(tmp_path / "e")) == 0


def test_sort_by_type(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "apple", "Banana", "banana", "Cherry"]), rng.choice([None, -1.0, 0.0, 7.5, 12.0])) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, t string, v double")
    names = [r.i for r in df.orderBy(*layout.sort_keys(df, "t"), "i").collect()]
    by_text = sorted(rows, key=lambda r: r[0])
    for key in (lambda r: r[1] or "", lambda r: (r[1] or "").lower()):
        by_text.sort(key=key, reverse=True)
    assert names == [r[0] for r in by_text]
    numbers = [r.i for r in df.orderBy(*layout.sort_keys(df, "v"), "i").collect()]
    assert numbers == [r[0] for r in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0.0), r[0]))]
    assert [r.v for r in df.orderBy(*layout.sort_keys(df, "v", False)).limit(1).collect()] == [None]


def test_report_order(spark):
    rows = exports.report_order(exports.category_report(rollups.category_summary(categorized(spark, SF), "item_id"))).collect()
    at = [r.section for r in rows].index("subcategories")
    names = [r.category for r in rows[:at]]
    assert names == [*sorted(names[:-1]), "GRAND TOTAL"] and rows[-1].category == "GRAND TOTAL"
    below = rows[at:-1]
    assert [r.category for r in below] == sorted(r.category for r in below)
    assert all(a.value >= b.value for a, b in zip(below, below[1:]) if a.category == b.category)
