"""Sheet grids: header detection, column mapping, exclusion of total and unnamed rows, projection to canonical columns.

A grid has dataset_id, _sheet_name, row_idx (0 up) and cells (array of strings, null for blank). Several files or
sheets make one frame; every operator works on all of them at once.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lotwise.functions import text as X, units as U
from lotwise.sources.tables import shared_table, sized

#: Canonical columns, and for each the header texts that stand for it, best first. Headers are compared as
#: header_text makes them, so one spelling covers item_name, item-name and Item Name.
ALIASES: dict[str, list[str]] = {
    "entity_name": [
        "entity vendor name", "vendor entity name", "vendor name", "entity name", "entity", "warehouse", "location", "store", "wh name", "warehouse name",
        "dc", "distribution center", "facility", "storage facility", "storage location", "plant", "warehouse location", "depot", "wh",
    ],
    "item_id": [
        "item id", "itemid", "sku", "sku id", "product id", "itemcode", "item code", "material id", "material code", "sku code",
        "article code", "articlecode", "material number", "sku number", "mat code",
    ],
    "upc": ["upc", "barcode", "ean", "gtin", "scan upc", "scanupc", "upc code", "barcode no"],
    "name": [
        "name", "product name", "product description", "product title", "product label", "product", "article", "article name", "item", "item name", "item title", "item description",
        "description", "title", "sku description", "sku name", "material", "material name", "material description", "style product", "style", "style description",
        "product details", "item details", "item desc", "prod name",
    ],
    "brand": ["brand", "brand name", "product brand", "manufacturer", "mfr", "make", "vendor", "principal", "principal brand", "mfr brand", "manufacturer brand", "mfr name", "brand label"],
    "variant_uom_text": [
        "variant uom text", "uom", "uom text", "unit", "unit of measure", "pack size", "size", "pack text", "weight uom", "pack", "uom code", "pack spec", "uom description", "packaging",
    ],
    "variant_mrp": [
        "variant mrp", "mrp", "price", "selling price", "sp", "unit mrp", "unit price", "rate", "unit rate", "cost", "unit cost", "list price", "currency unit rate", "rate per unit",
        "mrp inr", "unit price inr", "rate inr", "unit rate inr",
    ],
    "qty": [
        "qty", "quantity", "units", "units in stock", "inventory", "stock", "stock qty", "available qty", "available stock", "closing stock", "on hand", "net qty", "gross qty",
        "total units", "total qty", "sum of qty", "sum of quantity", "count", "qty in hand", "qty on hand", "stock on hand", "current stock", "closing units",
    ],
    "variant_id": ["variant id", "variant", "sku variant"],
    "item_type": ["item type", "type", "sub type", "stock type", "inventory type", "material type", "product type"],
    "type": ["type", "item type", "sub type"],
    "inventory_status": [
        "status", "inventory status", "stock status", "item status", "inv status", "quality status", "inventory state", "sellability", "saleability", "sellable status", "saleable status",
    ],
    "bad_inventory_type": ["bad inventory type", "bad inv type", "damage type", "damage reason", "defect type", "rejection type", "fault type", "loss type"],
    "remarks": ["remarks", "remark", "item remarks", "notes", "note", "comments", "comment", "reason", "reasons", "narrative", "item notes", "description remarks"],
    "condition": ["condition", "stock condition", "item condition", "grade", "stock grade", "quality", "quality grade", "item grade"],
    "disposition": ["disposition", "item disposition", "action", "action type", "recommended action", "lot disposition"],
    "l0": ["l0", "category", "category name", "product category", "main category", "l0 category", "department", "segment", "group", "division", "domain"],
    "subcategory": ["subcategory", "sub category", "sub group", "class", "product class", "l1", "l1 category"],
    "value": [
        "value", "total value", "amount", "total amount", "inventory value", "stock value", "inv amount", "inv value", "valuation", "total valuation", "extended cost", "extended amount",
        "total extended amount", "line total", "total inv value", "net valuation", "net amount", "val", "stock val", "valuation amount", "stock valuation", "extended value",
    ],
    "weight": [
        "weight", "unit weight", "unit weight kg", "item weight", "piece weight", "weight kg", "net weight", "net weight kg", "net weight spec", "net wt", "net wt kg", "single weight",
    ],
    "total_weight": [
        "total weight", "total weight kg", "totalweight", "gross weight", "gross weight kg", "gross wt", "gross wt kg", "total wt", "tot weight", "batch weight", "total gross weight",
    ],
}
REQUIRED = ["name"]
SCANNED = 10
#: What a header row's mapped columns add to its score, besides 3 for each.
BONUS = [(["name"], 8), (["qty"], 4), (["value", "variant_mrp"], 3), (["brand"], 2), (["entity_name"], 2), (["upc", "item_id"], 3)]
#: What a total row says.
TOTALS = r"(?i)^\s*(?:grand[\s-]*total|sub[\s-]*total|total\s*summary|total|summary)(?:\s*[:/].*|\s*row.*|\s*count.*|\s*\(.*)?\s*$"


def header_text(c: Column | str) -> Column:
    """A header as aliases are compared: lower case, separators as spaces, letters (Devanagari too) and digits only."""
    c = F.regexp_replace(F.lower(X.trimmed(c)), r"[\-_.]+", " ")
    return X.single_spaced(F.regexp_replace(c, r"[^a-z0-9\x{0900}-\x{097F}\s]+", ""))


def alias_table(spark: SparkSession, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(c, a, i) for c, names in (aliases or ALIASES).items() for i, a in enumerate(names)]
    return spark.createDataFrame(rows, "canonical string, header string, rank int")


def read_csv_grid(spark: SparkSession, path: str, dataset_id: str, width: int = 0) -> DataFrame:
    """CSV files as grids, one sheet a file; rows keep their numbers and all their cells, at least ``width`` of them.

    Quoted cells may hold commas, quotes and line breaks. A file is one text, as small as admission lets files be, and
    its records depend on all quotes before them, so each is read in the task that holds it; files are spread over tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = enumerate(csv.reader(io.StringIO(text, newline="")))
                while part := list(islice(((i, [x if x.strip() else None for x in r] + [None] * (width - len(r))) for i, r in rows if r), 4096)):
                    numbers, cells = zip(*part)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(numbers, pa.int32()), pa.array(cells, pa.list_(pa.string()))], names=["_sheet_name", "row_idx", "cells"])

    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("_sheet_name"), "value")
    rows = files.mapInArrow(run, "_sheet_name string, row_idx int, cells array<string>")
    return rows.select(F.lit(dataset_id).alias("dataset_id"), "_sheet_name", "row_idx", "cells")


def sheets_of_records(grid: DataFrame) -> DataFrame:
    """The grid without sheets that are summaries themselves."""
    return grid.where(~F.lower(F.trim("_sheet_name")).rlike(r"^\s*summary\s*$"))


def mapped_cells(grid: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """For each of a sheet's first rows and each canonical column the cell that names it: its best alias decides."""
    first = grid.where(F.col("row_idx") < SCANNED)
    cells = first.select("dataset_id", "_sheet_name", "row_idx", F.posexplode("cells").alias("pos", "cell"))
    cells = cells.select("dataset_id", "_sheet_name", "row_idx", "pos", "cell", header_text("cell").alias("header")).where("header <> ''")
    known = F.broadcast(alias_table(grid.sparkSession, aliases))
    return cells.join(known, "header").groupBy("dataset_id", "_sheet_name", "row_idx", "canonical").agg(F.min_by(F.struct("pos", "cell"), F.struct("rank", "pos")).alias("at"))


def detect_headers(grid: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """A row a sheet: header_row and the mapping canonical -> (pos, cell).

    Of the first ten rows with two or more cells and a known header the best scored wins, the earliest on ties; a
    sheet without any takes its first row.
    """
    hits = mapped_cells(grid, aliases).groupBy("dataset_id", "_sheet_name", "row_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("canonical", "at")))).alias("mapping"))
    filled = grid.where(F.col("row_idx") < SCANNED).select("dataset_id", "_sheet_name", "row_idx", F.size(F.filter("cells", lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")).alias("filled"))
    score = F.size("mapping") * 3
    for names, bonus in BONUS:
        any_ = F.lit(False)
        for n in names:
            any_ = any_ | F.map_contains_key("mapping", n)
        score = score + F.when(any_, bonus).otherwise(0)
    rows = hits.join(filled, ["dataset_id", "_sheet_name", "row_idx"]).where("filled >= 2").withColumn("score", score)
    best = rows.groupBy("dataset_id", "_sheet_name").agg(F.max_by(F.struct(F.col("row_idx").alias("header_row"), "mapping", "score"), F.struct("score", -F.col("row_idx"))).alias("b"))
    sheets = grid.select("dataset_id", "_sheet_name").distinct()
    empty = F.create_map().cast("map<string,struct<pos:int,cell:string>>")
    return sheets.join(best, ["dataset_id", "_sheet_name"], "left").select("dataset_id", "_sheet_name", F.coalesce("b.header_row", F.lit(0)).alias("header_row"), F.coalesce("b.mapping", empty).alias("mapping"), F.coalesce("b.score", F.lit(0)).alias("score"))


def missing_columns(headers: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Canonical columns that a sheet lacks, and whether each is required."""
    every = F.array(*map(F.lit, (aliases or ALIASES)))
    return headers.select("dataset_id", "_sheet_name", F.explode(F.array_except(every, F.map_keys("mapping"))).alias("canonical")).withColumn("required", F.col("canonical").isin(*REQUIRED))


def suggest_headers(headers: DataFrame, missing: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """For missing columns (canonical) the given header (column header) most like one of its aliases.

    One must contain the other, with a length ratio over 0.4. Aliases are a small fixed table, asked in the row.
    """
    options = [(c, a) for c, names in (aliases or ALIASES).items() for a in names]
    every = F.array(*(F.struct(F.lit(c).alias("canonical"), F.lit(a).alias("a")) for c, a in options))
    h = headers.select("header", header_text("header").alias("h")).where("h <> ''").distinct()
    a = F.col("o.a")
    near = h.select("header", "h", F.explode(F.filter(every, lambda o: F.col("h").contains(o["a"]) | o["a"].contains(F.col("h")))).alias("o"))
    near = near.withColumn("ratio", F.least(F.length(a), F.length("h")) / F.greatest(F.length(a), F.length("h"))).where("ratio > 0.4")
    best = near.groupBy("o.canonical").agg(F.max_by("header", F.struct("ratio", "header")).alias("header"))  # a row a canonical column
    return best.join(missing.select("canonical").distinct(), "canonical", "left_semi")


def tagged_rows(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Data rows below the header that hold anything: _source_row (1 up), name and why a row is left out (or null)."""
    h = headers.select("dataset_id", "_sheet_name", "header_row", "mapping")
    rows = grid.join(sized(h, 20_000), ["dataset_id", "_sheet_name"]).where(F.col("row_idx") > F.col("header_row"))
    rows = rows.where(F.exists("cells", lambda x: F.coalesce(x, F.lit("")) != ""))
    pos = lambda c: F.col("mapping")[c]["pos"]
    used = F.array_compact(F.array(*map(pos, ("upc", "qty", "variant_mrp", "value"))))
    free = F.filter(F.transform("cells", lambda x, i: F.when((F.length(X.trimmed(x)) > 2) & ~F.array_contains(used, i) & x.try_cast("double").isNull(), X.trimmed(x))), lambda x: x.isNotNull())
    name = F.when(pos("name").isNotNull(), X.trimmed(F.get("cells", pos("name")))).otherwise(F.coalesce(F.get(free, F.lit(0)), F.lit("")))
    rows = rows.withColumn("name", name)
    marked = F.exists(F.transform("cells", lambda x, i: X.trimmed(x).rlike(TOTALS) & ((F.col("name") == "") | (i == 0) | F.coalesce(i == pos("name"), F.lit(False)))), lambda x: F.coalesce(x, F.lit(False)))
    reason = F.when(F.col("name").rlike(TOTALS) | marked, "summary_row").when(F.col("name") == "", "missing_product_name")
    return rows.withColumn("_exclude_reason", reason).withColumn("_source_row", F.col("row_idx") + 1)


def ingest(grid: DataFrame, aliases: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, excluded) of all sheets: canonical columns, the units that weight headers name, and the raw cells by
    header; and the quarantine. with_weight_units completes the units."""
    grid = sheets_of_records(grid)
    headers = shared_table(detect_headers(grid, aliases))
    rows = tagged_rows(grid, headers)
    at = headers.select("dataset_id", "_sheet_name", F.col("header_row").alias("row_idx"))
    top = grid.where(F.col("row_idx") < SCANNED).join(sized(at, 20_000), ["dataset_id", "_sheet_name", "row_idx"], "left_semi").select("dataset_id", "_sheet_name", F.col("cells").alias("heads"))
    rows = rows.join(sized(shared_table(top), 20_000), ["dataset_id", "_sheet_name"], "left")
    heads = F.transform("cells", lambda x, i: F.struct(F.coalesce(F.when(X.trimmed(F.get("heads", i)) != "", X.trimmed(F.get("heads", i))), F.concat(F.lit("col_"), i.cast("string"))).alias("key"), x.alias("value")))
    filled = F.filter(heads, lambda x: x["value"].isNotNull())
    # of headers given twice the last filled cell counts; a sheet without such headers needs no comparison
    last = F.filter(filled, lambda x, i: ~F.exists(F.slice(filled, i + 2, F.size(filled)), lambda y: y["key"] == x["key"]))
    once = F.size(F.array_distinct(F.transform(filled, lambda x: x["key"]))) == F.size(filled)
    raw = F.map_from_entries(F.when(once, filled).otherwise(last))
    rows = rows.withColumn("_raw", raw)
    cell = lambda c: F.get("cells", F.col("mapping")[c]["pos"])
    names = [c for c in (aliases or ALIASES) if c != "name"]
    valid = rows.where("_exclude_reason is null").select("dataset_id", "_sheet_name", "_source_row", "name", *(cell(c).alias(c) for c in names), *(U.header_unit(F.col("mapping")[c]["cell"]).alias(f"{c}_unit_hint") for c in ("weight", "total_weight")), "_raw")
    number = lambda c: F.coalesce(cell(c).try_cast("double"), F.lit(0.0)).alias(c)
    out = rows.where("_exclude_reason is not null").select("dataset_id", "_sheet_name", "_source_row", "_exclude_reason", cell("upc").alias("upc"), F.when(F.col("name") != "", F.col("name")).alias("name"), number("qty"), number("variant_mrp"), number("value"), F.col("_raw").alias("_raw_cells"))
    return valid, out


def back_fill(records: DataFrame, *columns: str) -> DataFrame:
    """Fills null columns from the raw cells whose header reads like the column's name."""
    keyed = F.transform_keys("_raw", lambda k, v: header_text(k))
    return records.withColumns({c: F.coalesce(c, F.try_element_at(keyed, F.lit(c.replace("_", " ")))) for c in columns})


def sheet_stats(grid: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of each sheet: source, kept, left out, of these totals and unnamed."""
    g = sheets_of_records(grid)
    t = tagged_rows(g, detect_headers(g, aliases))
    n = lambda c: F.count_if(c)
    return t.groupBy("dataset_id", "_sheet_name").agg(F.count("*").alias("raw_rows"), n(F.col("_exclude_reason").isNull()).alias("kept"), n(F.col("_exclude_reason").isNotNull()).alias("excluded"), n(F.col("_exclude_reason") == "summary_row").alias("summary_rows"), n(F.col("_exclude_reason") == "missing_product_name").alias("no_name_rows"))


def infer_weight_unit(records: DataFrame) -> DataFrame:
    """A row a dataset: KG as the unit of bare weights if five or more rows have a weight and a mass in the pack text
    and 80 % of these agree. All rows count."""
    bare, named = F.regexp_replace("weight", ",", "").try_cast("double"), U.mass_kg("variant_uom_text")
    checked = (bare > 0) & named.isNotNull()
    c = records.groupBy("dataset_id").agg(F.count_if(checked).alias("checked"), F.count_if(checked & (F.abs(bare - named) < 1e-3)).alias("agreed"))
    return c.withColumn("weight_unit", F.when((F.col("checked") >= 5) & (F.col("agreed") >= 0.8 * F.col("checked")), "KG"))


def with_weight_units(records: DataFrame) -> DataFrame:
    """Records whose bare weights have a unit: the header's, else, where the unit weight's header names none, what the
    dataset's pack texts confirm (infer_weight_unit), for both weights."""
    units = shared_table(infer_weight_unit(records).where("weight_unit is not null").select(F.col("dataset_id").alias("__ds"), "weight_unit"))
    r = records.join(sized(units, 20_000), F.col("dataset_id") == F.col("__ds"), "left")
    own = F.col("weight_unit_hint")
    return r.withColumns({"weight_unit_hint": F.coalesce(own, "weight_unit"), "total_weight_unit_hint": F.when(own.isNull(), F.coalesce("weight_unit", "total_weight_unit_hint")).otherwise(F.col("total_weight_unit_hint"))}).drop("__ds", "weight_unit")


#: Headers of columns that hold a variant or a pack, whose texts may end in a price.
VARIANT_HEADERS = (
    "variant", "variant uom text", "variant uom", "uom", "uom text", "unit", "unit of measure", "pack size", "size", "pack text", "weight uom", "pack", "uom code", "pack spec", "uom description", "packaging",
    "sku variant", "variant name", "variant desc", "variant description", "variant pack",
)


def is_variant_header(c: Column | str) -> Column:
    """Whether a header names a variant or pack column; ids, prices and amounts are not among these names."""
    plain = X.single_spaced(F.regexp_replace(F.regexp_replace(F.lower(X.trimmed(c)), r"[\-_.]+", " "), r"[^a-z0-9\s]+", ""))
    return F.replace(plain, F.lit(" "), F.lit("")).isin(*(h.replace(" ", "") for h in VARIANT_HEADERS))


def without_prices(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """The grid with embedded prices taken off the cells below variant and pack headers (header_row of each sheet)."""
    at = headers.select("dataset_id", "_sheet_name", "header_row")
    heads = grid.join(sized(shared_table(at), 20_000), ["dataset_id", "_sheet_name"]).where(F.col("row_idx") == F.col("header_row"))
    heads = shared_table(heads.select("dataset_id", "_sheet_name", "header_row", F.transform("cells", lambda x: F.coalesce(is_variant_header(x), F.lit(False))).alias("strip")))
    r = grid.join(sized(heads, 20_000), ["dataset_id", "_sheet_name"], "left")
    below = F.col("row_idx") > F.col("header_row")
    cells = F.transform("cells", lambda x, i: F.when(below & F.get("strip", i) & x.isNotNull(), U.strip_price(x)).otherwise(x))
    return r.withColumn("cells", cells).drop("header_row", "strip")
