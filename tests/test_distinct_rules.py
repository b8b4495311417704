"""Rules over texts are asked once for each distinct text, and give what they give row by row."""

from collections import Counter

from pyspark.sql import functions as F

from lotwise.operators import audit, brands, clean, products, search, search_index
from lotwise.plans import queries
from lotwise.plans.queries import QUERIES, categorized
from lotwise.sources import tables
from lotwise.sources.inventory import inventory
from lotwise.streaming import incremental

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(map(str, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_by_distinct_texts(spark, monkeypatch):
    raw = inventory(spark, SF)
    few = clean.clean(raw)
    some = ["_source_row", "normalized_brand", "total_weight", "normalized_uom", "raw_bad_inventory_type", "inventory_status"]
    assert rows(clean.clean(raw, some)) == rows(few.select(*some))
    monkeypatch.setattr(clean, "once_for_all", _each)
    assert rows(clean.clean(raw)) == rows(few)


def _each(records, judges):
    for _, judge in judges:
        records = judge(records)
    return records


def test_once_for_all_with_few_and_many_keys(spark):
    r = spark.sql("SELECT id % 3 AS a, IF(id % 5 = 0, NULL, CAST(id % 5 AS STRING)) AS b, id AS c FROM range(100)")
    asked = [(["a"], lambda x: x.withColumn("twice", F.col("a") * 2)), (["b"], lambda x: x.withColumn("none", F.col("b").isNull())), (["c", "a"], lambda x: x.withColumn("sum", F.col("c") + F.col("a")))]
    for most in (0, 20, 1000):
        assert rows(tables.once_for_all(r, asked, most)) == rows(r.selectExpr("*", "a * 2 AS twice", "b IS NULL AS none", "c + a AS sum"))


def test_unit_values_reads_rules_once(spark):
    """Weights of packs are not worked out on each row, and nothing is written but distinct texts."""
    assert "regexp_extract" not in plan(QUERIES["unit_values"](spark, SF)).split("BroadcastExchange")[0]


def test_many_combinations_go_as_numbers(spark, monkeypatch):
    monkeypatch.setattr(tables, "MOST_ROWS", 12)
    r = spark.sql("SELECT IF(id % 7 = 0, NULL, CAST(id % 7 AS STRING)) AS a, id % 9 AS b, id FROM range(500)")
    judge = lambda x: x.withColumns({"c": F.col("b") % 2, "d": F.when(F.col("a").isNull(), "none")})
    got = tables.once_for_each(r, ["a", "b"], judge)
    assert "SortMergeJoin" not in plan(got) and "Exchange hash" not in plan(got)
    assert rows(got.select("a", "b", "id", "c", "d")) == rows(judge(r).select("a", "b", "id", "c", "d"))
    wide = lambda x: x.withColumn("e", F.concat_ws("-", "a", F.col("b")))
    assert rows(tables.once_for_each(r, ["a", "b"], wide).select("a", "b", "e")) == rows(wide(r).select("a", "b", "e"))


def test_audit_joins_no_records(spark):
    """Counts come from sums; only the list of records looks items up, and few of them are broadcast."""
    for name in ("audit_scores", "audit_severities"):
        got = plan(QUERIES[name](spark, SF))
        assert "SortMergeJoin" not in got and "Generate explode(failed" not in got
    assert "SortMergeJoin" not in plan(QUERIES["critical_records"](spark, SF))
    r = categorized(spark, SF).where("_source_row % 3 = 0")
    dup = {x.item_id for x in audit.duplicates(r).collect()}
    assert dup and {x.item_id for x in audit.issue_records(r, check="duplicate_item_id").collect()} == dup
    f = audit.flagged(r)
    by_rows = {x.c: x.n for x in f.select(F.explode("failed.check").alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}
    counted = {x.check: (x.n, x.total) for x in audit.audit(r).collect()}
    assert {c: n for c, (n, _) in counted.items() if n} == by_rows and len(counted) == len(audit.checks()) and {t for _, t in counted.values()} == {r.count()}
    s = audit.severities(r).first()
    assert s.affected == f.where(F.size("failed") > 0).count() and s.instances == sum(by_rows.values()) == s.critical + s.warning + s.info
    one = audit.issue_records(r).select("failed.check", "labels").limit(50).collect()
    assert all(",".join(sorted(x.check)) == x.labels for x in one)


def test_one_search_builds_no_index(spark, monkeypatch):
    """without an index a search reads records; with one it goes by the index, and finds the same."""
    def build(*a, **k):
        raise AssertionError("an index is built for one search")
    names = ["global_search", "filtered_records", "short_search"]
    monkeypatch.setattr(queries, "is_built", lambda s, sf, kind: False)
    monkeypatch.setattr(search_index, "build", build)
    got = [rows(QUERIES[n](spark, SF)) for n in names]
    monkeypatch.undo()
    queries.indexed(spark, SF)
    assert got == [rows(QUERIES[n](spark, SF)) for n in names]


def test_an_index_keeps_no_lists_beside_its_rows(spark, tmp_path):
    """places in a block take four bytes, and what rows are made of is gone."""
    index = search_index.build(categorized(spark, SF).select("_source_row", *search.SEARCHED), str(tmp_path / "i"))
    assert dict(index.rows.dtypes)["rows"] == "array<int>" and not (tmp_path / "i" / "lists").exists()


def test_a_state_keeps_what_is_asked_of_it(spark, tmp_path):
    """sums of brands or categories need no linking, and families no copy of the records."""
    r = categorized(spark, SF).where("_source_row % 9 = 0")
    for kept, tables_ in (("brands", {"brands"}), ("categories", {"categories"}), ("families", {"labels", "names", "families"})):
        incremental.load(str(tmp_path / kept), 0, r.select(*dict.fromkeys(incremental.READ[kept])), [kept])
        assert {p.name for p in (tmp_path / kept).iterdir()} == tables_
    assert rows(incremental.brand_master(spark, str(tmp_path / "brands")).select("brand_id", "record_count")) == rows(brands.brand_master(r).select("brand_id", "record_count"))


def test_products_carry_only_what_is_read(spark):
    """F8, F9, F12, F15, F16, F18: no stage is written with columns that a query does not read."""
    for name, columns in (("grouping_methods", 2), ("warehouse_by_category", 12), ("relabelled_records", 12), ("merged_brands", 12), ("business_profile", 8)):
        queries._written.clear()
        QUERIES[name](spark, SF)
        assert queries._written and min(len(t.columns) for _, t in queries._written.values()) <= columns, name
        assert all(len(t.columns) < 20 for _, t in queries._written.values()), name
    queries._written.clear()
    r = brands.assign_brands(categorized(spark, SF), brands.brand_master(categorized(spark, SF)))
    names = ["product_variant_id", "product_family_id", "uom", "mrp", "record_count", "total_qty"]
    assert rows(products.linked_variants(r).select(*names)) == rows(products.variants(products.with_variants(products.group_products(r))).select(*names))
