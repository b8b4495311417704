"""Rollups: warehouses, KPIs, categories, brands, products, sheets; shares, ranks and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lotwise.sources.tables import shared_table


def measures(sku: str = "product_family_id") -> list[Column]:
    return [
        F.count("*").alias("records"),
        F.round(F.sum("qty"), 2).alias("units"),
        F.round(F.sum("source_value"), 2).alias("value"),
        F.round(F.sum("total_weight"), 3).alias("weight"),
        F.round(F.sum("total_volume_l"), 3).alias("volume"),
        F.countDistinct(sku).alias("skus"),
        F.countDistinct("normalized_brand").alias("brands"),
    ]


def read(sku: str) -> list[str]:
    """The columns that measures read."""
    return ["qty", "source_value", "total_weight", "total_volume_l", sku, "normalized_brand"]


def rollup_by(records: DataFrame, *by: str, sku: str = "product_family_id") -> DataFrame:
    """Common measures by any columns: category, subcategory, brand, sheet, warehouse and so on.

    Each aggregate counts one column's distinct values, so that Spark need not expand every row for two of them; the
    second reads its columns only. They meet as a union, in which null groups match.
    """
    own = measures(sku)
    first = records.groupBy(*by).agg(*own[:-1])
    second = records.groupBy(*by).agg(own[-1])
    names = [c for c in first.columns if c not in by]
    return first.unionByName(second, allowMissingColumns=True).groupBy(*by).agg(*(F.max(c).alias(c) for c in [*names, "brands"]))


def kind() -> Column:
    """The stock kind in lower case; unknown where blank."""
    k = F.lower(F.coalesce("raw_bad_inventory_type", F.lit("")))
    return F.when(k == "", F.lit("unknown")).otherwise(k)


def warehouses(records: DataFrame, sku: str = "product_family_id") -> DataFrame:
    """A row a warehouse, with damaged, expired and near-expiry value, and a map of units and value by stock kind."""
    r = records.withColumn("__k", kind())
    by_kind = r.groupBy("normalized_warehouse", "__k").agg(F.round(F.sum("qty"), 2).alias("qty"), F.round(F.sum("source_value"), 2).alias("value"))
    maps = by_kind.groupBy("normalized_warehouse").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", F.struct("qty", "value").alias("v"))))).alias("status_breakdown"))
    of = lambda *kinds: F.round(F.sum(F.when(F.col("__k").isin(*kinds), F.col("source_value")).otherwise(0.0)), 2)
    flat = r.groupBy("normalized_warehouse").agg(
        F.countDistinct(sku).alias("sku_count"), F.round(F.sum("qty"), 2).alias("unit_count"), F.round(F.sum("source_value"), 2).alias("total_value"), F.round(F.sum("total_weight"), 3).alias("total_weight"),
        of("damaged").alias("damaged_value"), of("near_expiry", "nearexpiry").alias("near_expiry_value"), of("expired").alias("expired_value"),
    )
    return flat.join(maps, "normalized_warehouse")


def with_nulls(c: str) -> Column:
    """Distinct values, null counted as one."""
    return F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))


def kpis(records: DataFrame, sku: str = "product_family_id", brand: str = "normalized_brand") -> DataFrame:
    """One row of totals. Every distinct count is an aggregate of its own, which reads one column and expands no row."""
    k = kind()
    of = lambda *kinds: F.round(F.sum(F.when(k.isin(*kinds), F.col("source_value")).otherwise(0.0)), 2)
    conf = lambda c: F.count_if(F.col("subcategory_confidence") == c)
    sums = records.agg(
        F.round(F.sum("qty"), 2).alias("total_units"), F.round(F.sum("source_value"), 2).alias("total_value"), F.round(F.sum("total_weight"), 3).alias("total_weight"),
        of("damaged").alias("damaged_value"), of("near_expiry", "nearexpiry").alias("near_expiry_value"), conf("HIGH").alias("confidence_high"), conf("MEDIUM").alias("confidence_medium"), conf("LOW").alias("confidence_low"),
    )
    counts = {"total_skus": with_nulls(sku), "warehouse_count": F.countDistinct("normalized_warehouse"), "brand_count": with_nulls(brand), "category_count": with_nulls("normalized_category")}
    for name, count in counts.items():
        sums = sums.crossJoin(F.broadcast(records.agg(count.alias(name))))  # one row each
    return sums


def status_distribution(records: DataFrame) -> DataFrame:
    return records.groupBy(kind().alias("kind")).agg(F.count("*").alias("count"), F.round(F.sum("qty"), 2).alias("qty"), F.round(F.sum("source_value"), 2).alias("value"))


def confidence_distribution(records: DataFrame) -> DataFrame:
    return records.groupBy("subcategory_confidence").agg(F.count("*").alias("count"))


LEVELS = [["normalized_category", "subcategory"], ["normalized_category"], []]


def bitmaps(leaves: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of columns in every (category, subcategory): normalized_category, subcategory, column, bucket, bits.

    Values get numbers, dense within each part of the distinct values. A bitmap covers a bucket of 32,768 numbers, so its
    size is bounded, and bitmaps can be united: what holds for a category follows from its subcategories.
    """
    named = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    held = leaves.select(*LEVELS[0], named.alias("v")).select(*LEVELS[0], "v.column", "v.value").where("value is not null").distinct()
    codes = held.select("column", "value").distinct().sortWithinPartitions("column", "value").withColumn("code", F.monotonically_increasing_id())
    coded = held.join(codes, ["column", "value"])
    return coded.groupBy(*LEVELS[0], "column", F.bitmap_bucket_number("code").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))


def category_summary(records: DataFrame, sku: str = "product_family_id", count: str | None = None) -> DataFrame:
    """Categories, subcategories and the grand total, with level and share of all value and of the category's.

    Records are summed once, by (category, subcategory, sku, brand); all levels combine from that. Distinct skus and brands
    are exact: bitmaps over numbered values, united for each level. ``count`` names a column of row numbers if the
    records are sums already.
    """
    summed = ["records", "qty", "source_value", "total_weight", "total_volume_l"]
    cells = shared_table(records.groupBy(*LEVELS[0], sku, "normalized_brand").agg((F.sum(count) if count else F.count("*")).alias("records"), *(F.sum(c).alias(c) for c in summed[1:])))
    bits, rolled = shared_table(bitmaps(cells, [sku, "normalized_brand"])), None
    for g, by in zip((0, 1, 3), LEVELS):
        sums = cells.groupBy(*by).agg(*(F.sum(c).alias(c) for c in summed))
        united = bits.groupBy(*by, "column", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
        of = lambda c: F.coalesce(F.sum(F.when(F.col("column") == c, F.col("n"))), F.lit(0))  # noqa: E731, B023
        counts = united.groupBy(*by).agg(of(sku).alias("skus"), of("normalized_brand").alias("brands"))
        one = sums.unionByName(counts, allowMissingColumns=True).groupBy(*by).agg(
            F.max("records").alias("records"), F.round(F.max("qty"), 2).alias("units"), F.round(F.max("source_value"), 2).alias("value"), F.round(F.max("total_weight"), 3).alias("weight"),
            F.round(F.max("total_volume_l"), 3).alias("volume"), F.coalesce(F.max("skus"), F.lit(0)).alias("skus"), F.coalesce(F.max("brands"), F.lit(0)).alias("brands"),
        ).withColumn("g", F.lit(g))
        rolled = one if rolled is None else rolled.unionByName(one, allowMissingColumns=True)
    rolled = rolled.select(*LEVELS[0], "g", "records", "units", "value", "weight", "volume", "skus", "brands")
    level = F.when(F.col("g") == 0, "subcategory").when(F.col("g") == 1, "category").otherwise("total")
    share = lambda w: F.when(F.sum("value").over(w) != 0, F.round(100 * F.col("value") / F.sum("value").over(w), 2)).otherwise(0.0)
    of = rolled.withColumn("level", level)
    return of.withColumns({"share_of_level": share(W.partitionBy("level")), "share_of_category": F.when(F.col("g") == 0, share(W.partitionBy("level", "normalized_category")))}).drop("g")


def _bar(metric: str, most: str) -> Column:
    return F.when(F.col(most) > 0, F.greatest(F.lit(4.0), F.least(F.lit(100.0), F.round(100 * F.col(metric) / F.col(most), 1)))).otherwise(4.0)


def _share(metric: str, total: str) -> Column:
    return F.when(F.col(total) != 0, F.round(100 * F.col(metric) / F.col(total), 2)).otherwise(0.0)


#: Ranges of a metric within which groups are numbered.
RANGES = 64


def ranked(rolled: DataFrame, metric: str, key: str, descending: bool = True) -> DataFrame:
    """Adds rank, share of the total, and the bar width (share of the largest, 4 to 100). Ties go by key.

    Groups are numbered within ranges of the metric, and each range starts where those before it end: no task sorts all
    groups. Totals, ranges and their sizes are one row or RANGES rows at most.
    """
    rolled = shared_table(rolled)
    at = F.percentile_approx(metric, F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), 1000)
    whole = rolled.agg(F.sum(metric).alias("__total"), F.max(metric).alias("__most"), F.coalesce(at, F.array().cast(f"array<{rolled.schema[metric].dataType.simpleString()}>")).alias("__at"))
    above = F.size(F.filter("__at", lambda t: t >= F.col(metric) if descending else t < F.col(metric)))
    # a null metric sorts as the order has it: last when descending, first when ascending
    part = F.when(F.col(metric).isNull(), RANGES if descending else -1).otherwise(above)
    dealt = rolled.crossJoin(F.broadcast(whole)).withColumn("__part", part)  # one row of totals
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    order = [F.col(metric).desc() if descending else F.col(metric).asc(), F.col(key).asc()]
    r = dealt.join(F.broadcast(before), "__part").withColumn("rank", (F.row_number().over(W.partitionBy("__part").orderBy(*order)) + F.col("__before")).cast("int"))
    return r.withColumns({"share": _share(metric, "__total"), "bar": _bar(metric, "__most")}).drop("__part", "__before", "__total", "__most", "__at")


def top(records: DataFrame, by: str, metric: str = "value", k: int = 10, descending: bool = True, sku: str = "product_family_id") -> DataFrame:
    """The first k groups by a metric, with rank, share, bar as ranked gives them and how many groups there are.

    Each task keeps its first k groups; only those are sorted together."""
    rolled = shared_table(rollup_by(records, by, sku=sku))
    whole = rolled.agg(F.sum(metric).alias("__total"), F.max(metric).alias("__most"), F.count("*").alias("groups"))
    order = [F.col(metric).desc() if descending else F.col(metric).asc(), F.col(by).asc()]
    first = rolled.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))  # k rows
    r = first.crossJoin(F.broadcast(whole))  # one row of totals
    return r.withColumns({"share": _share(metric, "__total"), "bar": _bar(metric, "__most")}).drop("__total", "__most")


def top_and_other(rolled: DataFrame, key: str, metric: str, k: int = 4) -> DataFrame:
    """The first k rows by a metric, and the rest summed as Other, with how many they are."""
    rolled = shared_table(rolled)
    first = rolled.orderBy(F.col(metric).desc(), F.col(key).asc()).limit(k)
    kept = first.select(key, F.round(metric, 2).alias(metric), F.lit(1).cast("long").alias("members"))
    part = lambda df, m, n: df.agg(F.coalesce(F.sum(metric), F.lit(0.0)).alias(m), F.count("*").alias(n))
    rest = part(rolled, "all", "n").crossJoin(part(first, "top", "m")).where("n > m")  # one row each
    return kept.unionByName(rest.select(F.lit("Other").alias(key), F.round(F.col("all") - F.col("top"), 2).alias(metric), (F.col("n") - F.col("m")).alias("members")))


def brand_variants(records: DataFrame, brand: str) -> DataFrame:
    """A brand's families with their variants nested."""
    r = records.where(F.col("normalized_brand") == brand)
    v = r.groupBy("product_family_id", "product_variant_id", "normalized_uom").agg(F.round(F.sum("qty"), 2).alias("units"), F.round(F.sum("source_value"), 2).alias("value"), F.collect_set(mass_label()).alias("mass"))
    v = v.withColumn("mass", F.when(F.size("mass") > 1, F.lit("Mixed sources")).otherwise(F.element_at("mass", 1)))
    names = r.groupBy("product_family_id").agg(F.min_by("normalized_product_name", "_source_row").alias("name"))
    return v.groupBy("product_family_id").agg(F.count("*").alias("variant_count"), F.round(F.sum("units"), 2).alias("units"), F.round(F.sum("value"), 2).alias("value"), F.array_sort(F.collect_list(F.struct("normalized_uom", "units", "value", "mass"))).alias("variants")).join(names, "product_family_id")


def mass_label() -> Column:
    """Where a record's weight comes from, in words."""
    s = F.col("weight_source")
    return F.when(s == "source_total_weight", "Source total weight").when(s == "source_unit_weight_qty", "Unit weight x quantity").when(s == "derived_mass_uom", "Pack size x quantity").when(F.col("total_volume_l") > 0, "Volume only").otherwise("Unavailable")


def mass_provenance(records: DataFrame) -> DataFrame:
    """Each variant's weight provenance: one label, or mixed."""
    return records.groupBy("product_variant_id").agg(F.array_sort(F.collect_set(mass_label())).alias("labels")).select("product_variant_id", F.when(F.size("labels") > 1, F.lit("Mixed sources")).otherwise(F.element_at("labels", 1)).alias("provenance"))


def unit_value() -> Column:
    """What one unit is worth: value / quantity above one unit, else value, else price."""
    v = F.col("source_value")
    return F.when((v != 0) & (F.col("qty") > 1), v / F.col("qty")).when(v != 0, v).otherwise(F.coalesce("variant_mrp", F.lit(0.0)))
