"""The record cleaner: normalised text and numbers, values, and weights and volumes with their provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lotwise.functions import text as X, units as U
from lotwise.sources.grid import back_fill
from lotwise.operators.status import NON_SELLABLE, SELLABLE, has_signal
from lotwise.sources.tables import once_for_all

#: What a sheet's name says about its stock, in the order in which it is asked.
SHEET_KINDS = [
    (("( saleable )", "( sellable )"), "saleable"),
    (("( dump )", "non saleable", "nonsaleable"), "dump"),
    (("damage", "dn prn"), "damaged"),
    (("expired",), "expired"),
    (("near expiry", "nearexpiry"), "near_expiry"),
    (("dump",), "dump"),
    (("scrap",), "scrap"),
    (("quarantine",), "quarantine"),
    (("rtv",), "bad_rtv"),
    (("saleable", "salable", "good", "active", "available"), "saleable"),
]
#: Columns that a mapped record may lack; they count as null.
OPTIONAL = "brand entity_name item_id upc variant_id variant_uom_text variant_mrp qty value weight total_weight l0 item_type inventory_status bad_inventory_type remarks condition disposition weight_unit_hint total_weight_unit_hint".split()


def sheet_kind(sheet: Column | str) -> Column:
    """What kind of stock a sheet's name points to; null if it does not say."""
    s = X.lowered(sheet)
    out = F.lit(None).cast("string")
    for words, kind in reversed(SHEET_KINDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | s.contains(w)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def with_missing(records: DataFrame) -> DataFrame:
    """Records with all columns that cleaning reads. Blank ones are filled from the raw cells of like headers, if there
    are raw cells, and a blank item type from the type."""
    have = set(records.columns)
    if "_raw" in have:
        records = back_fill(records, *(c for c in OPTIONAL if c in have and not c.endswith("_hint")))
    if {"item_type", "type"} <= have:
        records = records.withColumn("item_type", F.coalesce(F.when(X.trimmed("item_type") != "", F.col("item_type")), "type"))
    out = records.withColumns({c: F.lit(None).cast("string") for c in OPTIONAL if c not in have})
    return out if "value_is_numeric" in have else out.withColumn("value_is_numeric", F.lit(False))


def _of_warehouses(r: DataFrame) -> DataFrame:
    raw = X.trimmed("entity_name")
    return r.withColumn("__warehouse", F.when(raw == "", F.lit("Unknown Warehouse")).otherwise(X.title(raw)))


def _of_names(r: DataFrame) -> DataFrame:
    r = r.withColumn("__name", X.trimmed("name"))
    judged = {"__product": X.clean_product_name("__name"), "__name_brand": X.brand_in_name("__name"), "__name_mass": U.mass_kg("__name"), "__name_volume": U.volume_l("__name"), "__name_pack": U.pack_in_name("__name")}
    return r.withColumns(judged).drop("__name")


def _of_packs(r: DataFrame) -> DataFrame:
    """Of a pack text, or the unit weight where that is blank."""
    r = r.withColumn("__uom", F.when(X.trimmed("variant_uom_text") != "", X.trimmed("variant_uom_text")).otherwise(X.trimmed("weight"))).withColumn("__bare", U.strip_price("__uom"))
    judged = {"__uom_mass": U.mass_kg("__uom"), "__uom_volume": U.volume_l("__uom"), "__uom_pack": U.pack_of_text("__bare"), "__uom_as_it_is": U.pack_as_it_is("__bare"), "__unit": U.weight_value("weight", "weight_unit_hint")}
    return r.withColumns(judged).drop("__uom", "__bare")


def _of_remarks(r: DataFrame) -> DataFrame:
    remark = F.lower(X.trimmed("remarks"))
    return r.withColumn("__remark_signal", has_signal(remark, SELLABLE) | has_signal(remark, NON_SELLABLE))


#: Rules over texts that repeat, with the columns that they read.
JUDGES = {
    "warehouses": (["entity_name"], _of_warehouses),
    "names": (["name"], _of_names),
    "brands": (["brand"], lambda r: r.withColumn("__given_brand", X.given_brand("brand"))),
    "packs": (["variant_uom_text", "weight", "weight_unit_hint"], _of_packs),
    "totals": (["total_weight", "total_weight_unit_hint"], lambda r: r.withColumn("__total", U.weight_value("total_weight", "total_weight_unit_hint"))),
    "remarks": (["remarks"], _of_remarks),
    "sheets": (["_sheet_name"], lambda r: r.withColumn("__sheet_kind", sheet_kind("_sheet_name"))),
}
#: Which rules clean columns need; those that are not named here need none, or the rules of weights.
RULES = {"normalized_warehouse": ["warehouses"], "normalized_product_name": ["names"], "normalized_brand": ["names", "brands"], "inventory_status": ["remarks"], "raw_bad_inventory_type": ["sheets"], "bad_inventory_type": ["sheets"]}
NO_RULES = {"dataset_id", "_sheet_name", "_source_row", "item_id", "upc", "variant_id", "qty", "variant_mrp", "source_value", "source_category", "item_type", "remarks", "condition", "disposition", "raw_brand"}


def clean(records: DataFrame, only: Sequence[str] = ()) -> DataFrame:
    """Mapped records as clean inventory records.

    Raw texts stay as raw_*. A numeric value of 0 counts as missing, a text "0" does not; a missing value is price
    times quantity. Rules over texts are asked once for each distinct text (JUDGES). Weight comes from the total weight, else unit weight times quantity, else a mass named in the pack
    text or name; a total weight without a known unit blocks the second of these. Volumes never become weights. ``only``
    names the columns that are wanted, if not all: rules of others are not asked.
    """
    r, asked = with_missing(records), set(JUDGES)
    if only:
        asked = {rule for c in only if c not in NO_RULES for rule in RULES.get(c, ["names", "packs", "totals"])}
    r = once_for_all(r, [JUDGES[rule] for rule in JUDGES if rule in asked])
    for rule in JUDGES.keys() - asked:  # of columns that are left out below
        r = JUDGES[rule][1](r)
    r = r.withColumns(
        {f"raw_{out}": X.trimmed(c) for out, c in {"entity_name": "entity_name", "product_name": "name", "brand": "brand", "category": "l0", "uom": "variant_uom_text", "item_type": "item_type", "remarks": "remarks", "condition": "condition", "disposition": "disposition"}.items()}
        | {f"raw_{c}": F.col(c) for c in ("weight", "total_weight")}
    )
    status = X.trimmed("inventory_status")
    promoted = F.when((status == "") & F.col("__remark_signal"), F.col("raw_remarks")).otherwise(status)
    bad = X.trimmed("bad_inventory_type")
    kind = F.when((bad != "") & (F.lower(bad) != "unknown"), bad).otherwise(F.coalesce("__sheet_kind", F.lit("unknown")))
    value = F.when(F.col("value_is_numeric") & (F.col("value").try_cast("double") == 0), F.lit(None)).otherwise(X.number("value"))
    r = r.withColumns(
        {
            "inventory_status": promoted,
            "raw_bad_inventory_type": kind,
            "bad_inventory_type": F.when(bad != "", bad).otherwise(kind),
            "normalized_warehouse": F.col("__warehouse"),
            "normalized_product_name": F.col("__product"),
            "normalized_brand": F.coalesce("__given_brand", "__name_brand", F.lit("Unknown Brand")),
            "source_category": F.col("raw_category"),
            "quantity": F.coalesce(X.number("qty"), F.lit(0.0)),
            "mrp": X.number("variant_mrp"),
            "__value": value,
        }
    )
    r = r.withColumns(
        {
            "source_value": F.coalesce("__value", F.when(F.col("quantity") > 0, F.col("mrp") * F.col("quantity")), F.lit(0.0)),
            "__mass": F.coalesce("__uom_mass", "__name_mass"),
            "__volume": F.coalesce("__uom_volume", "__name_volume"),
            "__pack": F.coalesce("__uom_pack", "__name_pack", "__uom_as_it_is"),
            "__has_total": F.coalesce(F.col("__total.raw_value") > 0, F.lit(False)),
            "__has_unit": F.coalesce(F.col("__unit.raw_value") > 0, F.lit(False)),
        }
    )
    r = r.withColumn("unit_volume_l", F.coalesce("__volume", F.lit(0.0)))
    known = lambda c: F.coalesce(F.col(f"{c}.unit").isin("KG", "G"), F.lit(False))
    r = r.withColumns(
        {
            "source_total_weight_kg": F.when(F.col("__has_total") & known("__total"), F.col("__total.value_kg")),
            "derived_source_weight_kg": F.when(~F.col("__has_total") & F.col("__has_unit") & known("__unit"), F.col("__unit.value_kg") * F.col("quantity")),
        }
    )
    neither = F.col("source_total_weight_kg").isNull() & F.col("derived_source_weight_kg").isNull()
    r = r.withColumn("derived_name_mass_kg", F.when(neither & (F.col("__mass") > 0), F.col("__mass") * F.col("quantity")))
    total, by_unit, by_name = F.col("source_total_weight_kg"), F.col("derived_source_weight_kg"), F.col("derived_name_mass_kg")
    diff = F.abs(F.col("__total.value_kg") - F.col("__unit.value_kg") * F.col("quantity"))
    agree = F.when(diff < 1e-5, "EXACT").when((diff <= 0.01) | (diff / F.greatest("__total.value_kg", F.lit(1.0)) < 0.005), "MINOR_ROUNDING").otherwise("MATERIAL_MISMATCH")
    volume = F.col("unit_volume_l") * F.col("quantity")
    r = r.withColumns(
        {
            "total_weight": F.coalesce(total, by_unit, by_name, F.lit(0.0)),
            "weight": F.when(total.isNotNull(), F.when(F.col("quantity") > 0, total / F.col("quantity")).otherwise(total)).when(by_unit.isNotNull(), F.col("__unit.value_kg")).when(by_name.isNotNull(), F.col("__mass")).otherwise(0.0),
            "weight_source": F.when(by_name.isNotNull(), "derived_mass_uom").when(total.isNotNull(), "source_total_weight").when(by_unit.isNotNull(), "source_unit_weight_qty").otherwise("unavailable"),
            "weight_unit_source": F.when(by_name.isNotNull(), F.lit("derived_from_uom")).when(total.isNotNull(), F.col("__total.provenance")).when(by_unit.isNotNull(), F.col("__unit.provenance")).otherwise(F.lit("unknown")),
            "weight_value": F.when(by_name.isNotNull(), F.col("__mass")).otherwise(F.col("__unit.raw_value")),
            "weight_unit": F.when(by_name.isNotNull(), F.lit("KG")).otherwise(F.coalesce("__unit.unit", F.lit("UNKNOWN"))),
            "total_weight_value": F.col("__total.raw_value"),
            "total_weight_unit": F.when(total.isNotNull(), F.lit("KG")).otherwise(F.coalesce("__total.unit", F.lit("UNKNOWN"))),
            "weight_validation_status": F.when(F.col("__has_total") & F.col("__has_unit"), F.when(known("__total") & known("__unit"), agree).otherwise("UNKNOWN_UNIT")).when(by_unit.isNotNull(), "EXACT").otherwise("N/A"),
            "total_volume_l": F.when(F.col("unit_volume_l") > 0, volume).otherwise(0.0),
            "volume_uom": F.when(F.col("__volume").isNotNull(), F.lit("L")),
            "normalized_uom": F.col("__pack.normalized_uom"),
            "uom_size": F.col("__pack.uom_size"),
            "uom_type": F.col("__pack.uom_type"),
        }
    )
    weighed = F.col("raw_weight").isNotNull() | F.col("raw_total_weight").isNotNull()
    mass = (
        F.when(total > 0, "VERIFIED")
        .when((by_unit > 0) | (by_name > 0), "DERIVED")
        .when(F.col("total_volume_l") > 0, "NOT_APPLICABLE")
        .when((F.col("quantity") > 0) & weighed, "UNKNOWN")
        .otherwise("NOT_APPLICABLE")
    )
    r = r.withColumn("mass_status", mass).withColumn("raw_uom", F.col("raw_uom"))
    hidden = [c for c in r.columns if c.startswith("__")]
    r = r.drop(*hidden, "qty", "variant_mrp", "value", "weight_unit_hint", "total_weight_unit_hint").withColumnsRenamed({"quantity": "qty", "mrp": "variant_mrp"})
    return r.select(*only) if only else r


def review(records: DataFrame) -> DataFrame:
    """Mapped rows that need a look, with an array of issues: no product name, or a quantity that is no number."""
    issues = F.array_compact(
        F.array(
            F.when(X.trimmed("name") == "", F.lit("Missing product name")),
            F.when(F.col("qty").isNotNull() & (X.trimmed("qty") != "") & F.col("qty").try_cast("double").isNull(), F.lit("Invalid quantity format")),
        )
    )
    return records.withColumn("issues", issues).where(F.size("issues") > 0)
