"""Searches by the index: equal to a scan, and reading far less."""

from collections import Counter

from pyspark.sql import functions as F

from lotwise.operators import search, search_index


def scanned(df):
    """Rows that the file scans of an executed frame put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan).collectLeaves()
    out = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        leaf = leaf.plan() if "QueryStage" in leaf.getClass().getName() else leaf
        below = leaf.collectLeaves()
        for j in range(below.size()):
            metrics = below.apply(j).metrics()
            if metrics.contains("numOutputRows"):
                out += metrics.apply("numOutputRows").value()
    return out


def test_searches(spark, tmp_path):
    n = 40_000
    name = F.when(F.col("id") % 9973 == 17, F.concat(F.lit("Rare Saffron "), F.col("id"))).when(F.col("id") % 3 == 0, "Chakki Atta").otherwise(F.concat(F.lit("Rice "), F.col("id") % 500))
    r = spark.range(n).select((n - F.col("id")).alias("_source_row"), name.alias("normalized_product_name"), F.when(F.col("id") % 7 > 0, F.lit("Été & Co.")).alias("normalized_brand"), F.concat(F.lit("SKU"), "id").alias("item_id"),
        F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise("").alias("upc"), F.lit("Grocery").alias("normalized_category"), F.lit("50% off_store").alias("normalized_warehouse"), F.lit("x").alias("_sheet_name"))
    index = search_index.build(r, str(tmp_path / "i"))
    for text in ("RARE saffron 17", "sku123", "atta", "été", "% off_", "17", "zzz", " Grocery "):
        expected = Counter(map(tuple, search.filtered(r, text).select("_source_row").collect()))
        assert Counter(map(tuple, search_index.filtered(index, text).select("_source_row").collect())) == expected, text
        found = search_index.find(index, text, 20).collect()
        assert sorted(x._source_row for x in found) == sorted(k for (k,) in expected)[:20] and all(x.matches == sum(expected.values()) for x in found)
    assert search_index.filtered(index, "", _sheet_name="x").count() == n and search_index.filtered(index, "saffron", _sheet_name="y").count() == 0
    assert search_index.filtered(index, "saffron").columns == r.columns
    assert scanned(index.records.where("_sheet_name = 'x'")) == n
    for text in ("saffron", "sku123", "rice 4"):
        assert scanned(search_index.find(index, text, 20)) < n / 4
    assert scanned(search_index.filtered(index, "saffron")) < n / 4
    assert scanned(index.grams.where(F.col("gram").isin("ffr"))) < index.grams.count() / 2
    nothing = search_index.build(r.where("false"), str(tmp_path / "e"))
    assert search_index.find(nothing, "atta").count() == 0 and search_index.filtered(nothing, "a").count() == 0


def test_ranges():
    assert search_index.ranges([]) == [] and search_index.ranges([4]) == [(4, 4)] and search_index.ranges([1, 2, 9]) == [(1, 1), (2, 2), (9, 9)]
    keys = list(range(0, 1000, 2)) + list(range(5000, 6000))
    got = search_index.ranges(keys)
    assert len(got) == search_index.RANGES and all(any(a <= k <= b for a, b in got) for k in keys) and not any(a <= 3000 <= b for a, b in got)
