"""Every registered query of the inventory engine against the same result in plain SQL, and invariants."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lotwise.operators import audit, brands, business, rollups, status
from lotwise.plans.queries import ORACLES, QUERIES, categorized, cleaned, sheet_grid
from lotwise.sources import grid

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rel = duck.execute(ORACLES[name])
    at = [d[0] for d in rel.description]
    assert sorted(at) == names
    expected = Counter(tuple(plain(r[at.index(n)]) for n in names) for r in rel.fetchall())
    assert Counter(tuple(map(plain, r)) for r in df.select(*(f"`{n}`" for n in names)).collect()) == expected


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_sums_agree(spark):
    r = categorized(spark, SF)
    n = r.count()
    assert cleaned(spark, SF).count() == n
    s = status.reconcile_status(r).first()
    assert s.reconciled and s.records == n == s.sellable_records + s.non_sellable_records + s.unknown_records
    levels = {x.level: x.v for x in rollups.category_summary(r, "item_id").groupBy("level").agg(F.sum("value").alias("v")).collect()}
    assert levels["category"] == pytest.approx(levels["total"]) == pytest.approx(levels["subcategory"])
    assert all(0 <= x.score <= 100 for x in audit.scores(audit.audit(r)).collect())
    for b in business.reconcile(r).collect():
        assert b.both_rows + b.canonical_only_rows == b.canonical_rows and b.both_rows + b.business_only_rows == b.business_rows
    master = brands.brand_master(r)
    merged = brands.merge_brands(master, spark.createDataFrame([("1 brand", "2 brand")], "retired string, kept string"))
    total = lambda d: d.agg(F.sum("record_count"), F.round(F.sum("total_value"), 2)).first()
    assert tuple(total(master)) == tuple(total(merged))
    g = sheet_grid(spark, SF)
    stats = grid.sheet_stats(g)
    assert stats.where("kept + excluded <> raw_rows").count() == 0
    records, excluded = grid.ingest(g)
    assert records.count() + excluded.count() == stats.agg(F.sum("raw_rows")).first()[0]


def test_audit_of_known_rows(spark):
    base = cleaned(spark, SF).limit(1).drop("upc", "item_id").withColumns({"normalized_category": F.lit("Grocery"), "subcategory_confidence": F.lit("HIGH"), "is_status_conflict": F.lit(False), "status_confidence": F.lit("HIGH"), "total_weight": F.lit(1.0), "total_volume_l": F.lit(1.0), "qty": F.lit(1.0), "variant_mrp": F.lit(5.0), "source_value": F.lit(5.0), "normalized_brand": F.lit("B")})
    r = base.crossJoin(spark.range(8000)).withColumns({"upc": F.when(F.col("id") < 1000, "").otherwise("12345678"), "item_id": F.col("id").cast("string")})
    got = {x.dim: x.score for x in audit.scores(audit.audit(r)).collect()}
    assert got["identity"] == 96.5 and got["overall"] == 99.1
    got = {x.dim: x.score for x in audit.scores(audit.audit(r.withColumns({"upc": F.lit("12345678"), "source_value": F.when(F.col("id") < 10, -50.0).otherwise(5.0)}))).collect()}
    assert got["financial"] == 78.8 and got["overall"] == 95.8
    empty = {x.dim: x.score for x in audit.scores(audit.audit(r.where("false"))).collect()}
    assert empty["overall"] == 100


def test_similar_brands_are_all_found(spark):
    import random

    rng = random.Random(3)
    names = list({"".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))).strip() or "a" for _ in range(120)})
    got = {(r.fingerprint_a, r.fingerprint_b) for r in brands.similar_brands(spark.createDataFrame([(n, n) for n in names], "brand_fingerprint string, canonical_brand_name string")).collect()}
    def lev(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(now[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]
    sim = lambda a, b: (max(len(a), len(b)) - lev(a, b)) / max(len(a), len(b))
    assert got == {(a, b) for a in names for b in names if a < b and 0.7 <= sim(a, b) < 1}
