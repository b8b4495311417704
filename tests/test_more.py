"""Wide and quoted CSV cells, header units, price strips, vocabularies, dataset lists, tabs, entities, profiles, formats."""

import json
import random

from pyspark.sql import functions as F

from lotwise.functions import formats, vocabulary as V
from lotwise.operators import category, clean, products, rollups, search, status
from lotwise.sources import exports, grid, tables


def test_csv_keeps_all_columns_and_quoted_line_breaks(spark, tmp_path):
    heads = ["Product Name", *(f"Extra {i}" for i in range(90)), "Qty"]
    (tmp_path / "w.csv").write_text(",".join(heads) + "\n" + ",".join(['"Rice\n5 ""kg"", fine"', *map(str, range(90)), "7"]) + "\n\nDal," + "," * 90 + "2\n")
    g = grid.read_csv_grid(spark, str(tmp_path / "w.csv"), "d")
    assert [(r.row_idx, len(r.cells)) for r in g.orderBy("row_idx").collect()] == [(0, 92), (1, 92), (3, 92)]
    records, _ = grid.ingest(g)
    got = {r._source_row: r for r in records.collect()}
    assert got[2].name == 'Rice\n5 "kg", fine' and got[2].qty == "7" and got[2]._raw["Extra 89"] == "89" and got[4].qty == "2"


def test_alias_order_and_raw_cells(spark):
    rows = [("d", "S", 0, ["item name", "product", "type", "Code", "Code"]), ("d", "S", 1, ["a", "b", "Saleable", "1", None]), ("d", "S", 2, ["c", "e", None, "1", "2"])]
    records, _ = grid.ingest(spark.createDataFrame(rows, "dataset_id string, _sheet_name string, row_idx int, cells array<string>"))
    got = {r._source_row: r for r in records.collect()}
    assert got[2].name == "b" and got[2].item_type == got[2].type == "Saleable" and got[2]._raw["Code"] == "1" and got[3]._raw["Code"] == "2"


def test_header_and_sampled_units_reach_the_cleaner(spark):
    def sheet(ds, head, cells):
        return [(ds, "S", 0, ["Product Name", head, "UOM", "Qty"]), *((ds, "S", i + 1, c) for i, c in enumerate(cells))]
    rows = sheet("kg", "Net Weight KG", [["a", "2", None, "3"]]) + sheet("none", "weight", [["a", "2", None, "3"]])
    rows += sheet("seen", "weight", [["a", "2", "2 kg", "1"]] * 6 + [["b", "4", None, "2"]])
    records, _ = grid.ingest(spark.createDataFrame(rows, "dataset_id string, _sheet_name string, row_idx int, cells array<string>"))
    got = clean.clean(grid.with_weight_units(records)).groupBy("dataset_id").agg(F.max("total_weight").alias("w")).collect()
    assert {r.dataset_id: r.w for r in got} == {"kg": 6.0, "none": 0.0, "seen": 8.0}


def test_prices_leave_variant_columns(spark):
    heads = ["Variant", "Variant ID", "Pack-Size", "UOM_Text", "MRP", "weight uom", "Unit of Measure", "units"]
    got = spark.createDataFrame([(h,) for h in heads], "h string").select("h", grid.is_variant_header("h").alias("v")).collect()
    assert {r.h for r in got if r.v} == {"Variant", "Pack-Size", "UOM_Text", "weight uom", "Unit of Measure"}
    g = spark.createDataFrame([("d", "S", 0, ["Name", "UOM", "Note"]), ("d", "S", 1, ["a", "10 kg - Rs 749.0", "x - Rs 5"])], "dataset_id string, _sheet_name string, row_idx int, cells array<string>")
    out = grid.without_prices(g, spark.createDataFrame([("d", "S", 0)], "dataset_id string, _sheet_name string, header_row int"))
    assert [r.cells for r in out.orderBy("row_idx").collect()] == [["Name", "UOM", "Note"], ["a", "10 kg", "x - Rs 5"]]
    rows = spark.createDataFrame([("S", "Saleable", "5 kg - 480")], "_sheet_name string, inventory_status string, variant_uom_text string")
    assert status.kept_rows(rows, ("variant_uom_text",)).first().variant_uom_text == "5 kg"


def categories(spark, rows, **more):
    df = spark.createDataFrame([(i, c, n, b) for i, (c, n, b) in enumerate(rows)], "i int, source_category string, normalized_product_name string, normalized_brand string")
    return [(r.normalized_category, r.subcategory) for r in category.categorize(df, **more).orderBy("i").collect()]


def test_categories_of_the_full_vocabulary(spark, tmp_path):
    rows = [
        ("Furniture", "Walnut Bookshelf", "X"), ("quarantine", "Walnut Kernels", "X"), ("Master", "Salted Peanut Chips", "X"), ("Apparel", "Rice Print T-Shirt", "X"), ("", "Bru Gold", "X"), ("dals", "Mixed Pack", "X"),
        ("", "Chicken Bites", "Pedigree"), ("bakery & biscuits", "Plain Pack", "X"), ("", "Ceramic Mug", "X"), ("", "Protein Biscuit", "X"), ("", "Soy Protein Powder", "X"), ("", "Refined Soyabean Oil", "X"), ("Books", "Rice Cooking Guide", "X"),
    ]
    assert categories(spark, rows) == [
        ("Furniture", "Storage & Beds"), ("Grocery", "Dry Fruits & Nuts"), ("Grocery", "Snacks & Namkeen"), ("Apparel", "Topwear"), ("Grocery", "Coffee"), ("Grocery", "Dals & Pulses"),
        ("Home Care", "Pet Care"), ("Grocery", "Biscuits & Cookies"), ("Home Care", "Kitchen Accessories"), ("Grocery", "Biscuits & Cookies"), ("Sports Nutrition", "Protein & Workout Supplements"), ("Grocery", "Oils"), ("Books", "Academic & Non-Fiction"),
    ]
    own = {"domains": [{"name": "r", "category": "Garden", "match": {"words": ["hose"]}, "gate": None, "subcategories": [["Pipes", ["hose"]]], "otherwise": "General"}], "foods": [], "taxonomy": [["Garden", "Pipes", ["hose"]]]}
    (tmp_path / "v.json").write_text(json.dumps(own))
    v = V.load(spark, str(tmp_path / "v.json"))
    assert categories(spark, [("", "Red Hose", "X"), ("", "Basmati Rice", "X")], domains=v.domains, foods=v.foods, taxonomy=v.taxonomy) == [("Garden", "Pipes"), ("Other / Uncategorized", "General")]
    assert v.buckets == tuple(V.BUCKETS) and len(V.BUCKETS) == 20 and len(V.SUBCATEGORIES) == 17 and len(V.TAXONOMY) == 89


def test_datasets(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "dataset_id string, x int")
    tables.save_dataset(spark, folder, "a", "first", "2024-01-01 00:00:00", {"records": rows, "brands": rows.drop("dataset_id").limit(1)})
    tables.save_dataset(spark, folder, "b", "second", "2024-02-01 00:00:00", {"records": rows})
    assert [(r.dataset_id, r.name) for r in tables.datasets(spark, folder).collect()] == [("b", "second"), ("a", "first")]
    assert tables.load(spark, folder, "records", "a").count() == 2
    tables.delete_dataset(spark, folder, "a")
    assert [r.dataset_id for r in tables.datasets(spark, folder).collect()] == ["b"] and tables.load(spark, folder, "records").count() == 1 and len(tables.CHILDREN) == 10


def test_a_failed_save_leaves_the_dataset(spark, tmp_path):
    folder, name = str(tmp_path), "a b:c/d=é"
    rows = spark.createDataFrame([(name, 1), ("other", 2)], "dataset_id string, x int")
    tables.save_dataset(spark, folder, name, "first", "2024-01-01 00:00:00", {"records": rows, "issues": rows})
    broken = rows.withColumn("x", F.when(F.raise_error(F.lit("no")).isNull(), F.col("x")))
    try:
        tables.save_dataset(spark, folder, name, "second", "2024-02-01 00:00:00", {"records": rows, "brands": broken})
        raise AssertionError("saved")
    except Exception as e:
        assert "no" in str(e)
    assert [r.name for r in tables.datasets(spark, folder).collect()] == ["first"] and tables.load(spark, folder, "records", name).count() == 1
    tables.save_dataset(spark, folder, name, "third", "2024-03-01 00:00:00", {"records": rows.withColumn("x", F.col("x") + 6)})
    assert [r.name for r in tables.datasets(spark, folder).collect()] == ["third"] and [r.x for r in tables.load(spark, folder, "records", name).collect()] == [7]
    assert not [p for p in (tmp_path / "issues").iterdir() if p.name.startswith("dataset_id")]
    tables.delete_dataset(spark, folder, name)
    assert not list((tmp_path / "datasets").glob("dataset_id*"))


def test_tabs_and_formats(spark):
    names = ["Summary", "x" * 40, "x" * 40 + "y", "a/b", "a?b"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "_sheet_name string, _source_row int")
    got = {r._sheet_name: r.tab for r in exports.tab_titles(df).collect()}
    assert len(set(got.values())) == 5 and got["a/b"] == "a_b" and got["Summary"] == "Summary_1" and got["x" * 40] == "x" * 31 and got["x" * 40 + "y"] == "x" * 27 + "_1"
    r = spark.createDataFrame([(1234567.5, 12.0, None)], "a double, b double, c double").select(*map(formats.number, "abc")).first()
    assert tuple(r) == ("12,34,567.5", "12", formats.DASH)
    t = spark.sql("SELECT timestamp '2024-03-05 17:30:00' AS t, cast(null AS timestamp) AS n")
    assert tuple(t.select(formats.date("t"), formats.short_date("t"), formats.date("n")).first()) == ("05 Mar 2024, 05:30 pm", "05 Mar 2024", formats.DASH)


def test_entity_levels(spark):
    known = spark.createDataFrame([("category", "Personal Care", 1, "personal care"), ("subcategory", "Rice", 2, "chawal"), ("subcategory", "Hair Care", 3, "hair care"), ("brand", "Acme Foods", 4, "acme foods"), ("warehouse", "Delhi Depot", 9, "delhi depot")], "kind string, name string, rank int, norm string")
    terms = ["Personal care", "chawal", "hair care", "acme foods", "old chawal sacks", "best hair care oil", "all personal care", "acme", "stock at delhi depot", "grocery", "zzz"]
    got = {r.term: (r.name, r.rank) for r in search.resolve(spark.createDataFrame([(t,) for t in terms], "term string"), known).collect()}
    assert got == {"Personal care": ("Personal Care", 1), "chawal": ("Rice", 2), "hair care": ("Hair Care", 3), "acme foods": ("Acme Foods", 4), "old chawal sacks": ("Rice", 5), "best hair care oil": ("Hair Care", 6), "all personal care": ("Personal Care", 7), "acme": ("Acme Foods", 8), "stock at delhi depot": ("Delhi Depot", 9)}
    asked = spark.createDataFrame([("Foods",), ("acme foods",), ("ac",)], "term string")
    assert {r.term: r.name for r in search.resolve_brands(asked, spark.createDataFrame([("Acme Foods",), ("Zed Foods",)], "name string")).collect()} == {"Foods": "Acme Foods", "acme foods": "Acme Foods"}
    asked = spark.createDataFrame([("delh",), ("the delhi depot yard",), ("pune",)], "term string")
    assert {r.term: r.name for r in search.resolve_warehouses(asked, spark.createDataFrame([("Delhi Depot",), ("Goa",)], "name string")).collect()} == {"delh": "Delhi Depot", "the delhi depot yard": "Delhi Depot"}


def test_profiles_link_families(spark):
    base = dict(dataset_id="d", _sheet_name="S", brand_id="b", normalized_category="Grocery", upc="", item_id="")
    names = ["Amul Butter Salted", "Premium Amul Butter Salted", "Amul Butter Unsalted", "Amul Butter Salted"]
    df = spark.createDataFrame([{**base, "_source_row": i, "normalized_product_name": n} for i, n in enumerate(names)])
    ids = lambda **k: {r._source_row: (r.product_family_id, r.grouping_method) for r in products.group_products(df, **k).collect()}
    plain = ids()
    assert plain[0][0] == plain[3][0] != plain[1][0] and [plain[i][1] for i in range(4)] == ["new", "new", "new", "name_tokens"]
    products.register_profile("dairy", products.Profile({"salted", "unsalted"}, {"premium"}))
    linked = ids(profile="dairy")
    assert linked[0][0] == linked[1][0] == linked[3][0] != linked[2][0] and linked[1][1] == "name_tokens"


def test_ranks_equal_a_plain_sort(spark):
    rng = random.Random(1)
    rows = [(f"g{i:03}", rng.choice([None, 0.0, 5.0, 5.0, float(rng.randint(0, 400))])) for i in range(700)]
    for down in (True, False):
        got = rollups.ranked(spark.createDataFrame(rows, "g string, v double"), "v", "g", down).collect()
        key = lambda r: ((r[1] is None) == down, (-1 if down else 1) * (r[1] or 0), r[0])
        assert {r.g: r.rank for r in got} == {g: i + 1 for i, (g, _) in enumerate(sorted(rows, key=key))}
