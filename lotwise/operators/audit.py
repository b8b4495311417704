"""Data-quality issues, audit checks and scores."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lotwise.functions import text as X
from lotwise.sources.tables import shared_table, sized

#: Penalty of a severity, weight of a dimension.
AMPLIFIERS = {"info": 0.1, "warning": 1.0, "critical": 5.0}
DIMENSIONS = {"identity": 0.25, "classification": 0.20, "status": 0.15, "measurement": 0.20, "financial": 0.20}
SAMPLE = 20


def _off(c: Column, mrp: Column, qty: Column) -> Column:
    """Whether a value differs from price times quantity by over 10 and over 5 %."""
    diff = F.abs(c - mrp * qty)
    return (c != 0) & (mrp != 0) & (qty != 0) & (diff > 10) & (diff / F.greatest(c, F.lit(1.0)) > 0.05)


def issue_flags() -> list[tuple[str, str, Column]]:
    """(issue, severity, condition) of the quick detectors."""
    mrp, value, qty = F.col("variant_mrp"), F.col("source_value"), F.col("qty")
    no = lambda c: F.coalesce(c, F.lit(0.0)) == 0
    return [
        ("missing_brand", "medium", F.coalesce("raw_brand", F.lit("")) == ""),
        ("missing_weight", "low", no(F.col("total_weight"))),
        ("value_discrepancy", "medium", _off(value, mrp, qty)),
        ("low_confidence_grouping", "high", F.col("normalization_confidence") == "LOW"),
        ("missing_mrp", "medium", no(mrp)),
        ("zero_quantity", "high", no(qty)),
        ("outlier_values", "medium", (mrp > 100000) | (mrp < 0) | (value < 0)),
        ("zero_price_items", "low", (qty > 0) & no(mrp) & no(value)),
    ]


def issues(records: DataFrame, id_col: str = "id") -> DataFrame:
    """Detected issues with count, severity and the first ids (discrepancies list none), from one pass."""
    tags = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("issue_type"), F.lit(s).alias("severity"))) for n, s, c in issue_flags())))
    r = records if "normalization_confidence" in records.columns else records.withColumn("normalization_confidence", F.lit("HIGH"))
    tagged = r.select(F.col(id_col).alias("id"), F.col("_source_row").alias("seq"), F.explode(tags).alias("t")).select("id", "seq", "t.issue_type", "t.severity")
    counts = tagged.groupBy("issue_type", "severity").agg(F.count("*").alias("count"))
    first = tagged.where("issue_type <> 'value_discrepancy'").withColumn("rn", F.row_number().over(W.partitionBy("issue_type").orderBy("seq", "id"))).where(F.col("rn") <= SAMPLE)
    samples = first.groupBy("issue_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]).alias("record_ids"))
    return counts.join(F.broadcast(samples), "issue_type", "left").withColumn("record_ids", F.coalesce("record_ids", F.array().cast("array<string>")))


def checks(fixed: bool = False) -> list[tuple[str, str, str, Column]]:
    """(check, dimension, severity, condition) of the audit; needs __duplicate on the records.

    ``fixed``: unknown_brand also finds the cleaner's own placeholder.
    """
    item, upc, brand, cat = (X.trimmed(c) for c in ("item_id", "upc", "normalized_brand", "normalized_category"))
    digits = F.length(F.regexp_replace(upc, r"\D", ""))
    w, v, q, mrp, value = (F.col(c) for c in ("total_weight", "total_volume_l", "qty", "variant_mrp", "source_value"))
    none = lambda c: c.isNull() | F.isnan(c)
    return [
        ("missing_item_id", "identity", "warning", item == ""),
        ("missing_upc", "identity", "info", upc == ""),
        ("invalid_upc", "identity", "warning", (upc != "") & ~digits.isin(8, 12, 13, 14)),
        ("duplicate_item_id", "identity", "critical", F.col("__duplicate")),
        ("uncategorized", "classification", "warning", cat.isin("", "Other / Uncategorized", "Uncategorized")),
        ("unknown_brand", "classification", "warning", brand.isin("", "Unknown", *(["Unknown Brand"] if fixed else []))),
        ("low_conf_class", "classification", "info", F.upper("subcategory_confidence") == "LOW"),
        ("status_conflict", "status", "warning", F.col("is_status_conflict")),
        ("low_conf_status", "status", "info", F.upper("status_confidence") == "LOW"),
        ("missing_weight", "measurement", "info", none(w) | (w == 0)),
        ("missing_volume", "measurement", "info", none(v) | (v == 0)),
        ("negative_weight", "measurement", "critical", w < 0),
        ("negative_volume", "measurement", "critical", v < 0),
        ("zero_quantity", "measurement", "critical", q.isNull() | (q == 0)),
        ("negative_quantity", "measurement", "critical", q < 0),
        ("missing_mrp", "financial", "warning", none(mrp)),
        ("zero_mrp", "financial", "info", mrp == 0),
        ("missing_value", "financial", "warning", none(value) & (q > 0)),
        ("zero_value", "financial", "info", (value == 0) & (q > 0)),
        ("negative_mrp", "financial", "critical", mrp < 0),
        ("negative_value", "financial", "critical", value < 0),
        ("value_discrepancy", "financial", "warning", _off(value, mrp, q)),
    ]


def duplicates(records: DataFrame) -> DataFrame:
    """Item ids that occur more than once: item_id, n."""
    return records.where(X.trimmed("item_id") != "").groupBy(X.trimmed("item_id").alias("item_id")).agg(F.count("*").alias("n")).where("n > 1")


#: The columns that the checks read.
READ = ["item_id", "upc", "normalized_brand", "normalized_category", "total_weight", "total_volume_l", "qty", "variant_mrp", "source_value", "subcategory_confidence", "is_status_conflict", "status_confidence"]


def _with_duplicate(records: DataFrame) -> DataFrame:
    """Records with __duplicate. Mostly either the repeated item ids or the others are few: these are then broadcast."""
    items = shared_table(records.where(X.trimmed("item_id") != "").groupBy(X.trimmed("item_id").alias("__item")).agg((F.count("*") > 1).alias("__repeated")))
    n = items.agg(F.count_if("__repeated").alias("n"), F.count("*").alias("all")).first()
    repeated = 2 * n["n"] <= n["all"]
    listed = F.col("__repeated") if repeated else ~F.col("__repeated")
    r = records.withColumn("__k", F.when(X.trimmed("item_id") != "", X.trimmed("item_id"))).join(sized(items.where(listed).select("__item")), F.col("__k") == F.col("__item"), "left")
    found = F.col("__item").isNotNull()
    return r.withColumn("__duplicate", found if repeated else F.col("__k").isNotNull() & ~found).drop("__k", "__item")


def flagged(records: DataFrame, fixed: bool = False) -> DataFrame:
    """Records with the array ``failed`` of (check, dim, severity). Empty item ids are never joined."""
    r = _with_duplicate(records)
    made = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("check"), F.lit(d).alias("dim"), F.lit(s).alias("severity"))) for n, d, s, c in checks(fixed)]
    return r.withColumn("failed", F.array_compact(F.array(*made))).drop("__duplicate")


def _counted(records: DataFrame, fixed: bool = False) -> DataFrame:
    """One row: total, a count for each check, and affected, the records with any. A record is a duplicate if its item id has
    more than one, which follows from sums by item id: no record is joined."""
    own = [(n, F.coalesce(c, F.lit(False))) for n, _, _, c in checks(fixed) if n != "duplicate_item_id"]
    item = F.when(X.trimmed("item_id") != "", X.trimmed("item_id"))
    by_item = records.groupBy(item.alias("__item")).agg(F.count("*").alias("__n"), F.count_if(reduce(or_, (c for _, c in own))).alias("__any"))
    repeated, n = F.col("__item").isNotNull() & (F.col("__n") > 1), F.col("__n")
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    of_items = by_item.agg(whole(F.when(repeated, n)).alias("duplicate_item_id"), whole(F.when(repeated, n).otherwise(F.col("__any"))).alias("affected"))
    return records.agg(F.count("*").alias("total"), *(F.count_if(c).alias(name) for name, c in own)).crossJoin(F.broadcast(of_items))  # one row each


def audit(records: DataFrame, fixed: bool = False) -> DataFrame:
    """All checks with their counts, of records in all; checks that find nothing count 0."""
    made = (F.struct(F.lit(n).alias("check"), F.lit(d).alias("dim"), F.lit(s).alias("severity"), F.col(n).alias("n")) for n, d, s, _ in checks(fixed))
    return _counted(records, fixed).select(F.explode(F.array(*made)).alias("x"), "total").select("x.*", "total")


def scores(audited: DataFrame) -> DataFrame:
    """Score of each dimension (100 less damped penalties, one decimal) and, as dimension overall, their weighted sum."""
    amp, weight = (F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) for m in (AMPLIFIERS, DIMENSIONS))
    part = F.when((F.col("n") > 0) & (F.col("total") > 0), amp[F.col("severity")] * F.sqrt(F.col("n") / F.col("total"))).otherwise(0.0)
    dims = audited.groupBy("dim").agg(F.least(F.lit(1.0), F.sum(part)).alias("p")).select("dim", (F.floor((1 - F.col("p")) * 1000 + 0.5) / 10).alias("score"))
    overall = dims.agg(F.sum(F.col("score") * weight[F.col("dim")]).alias("s")).select(F.lit("overall").alias("dim"), (F.floor(F.col("s") * 10 + 0.5) / 10).alias("score"))
    return dims.unionByName(overall)


def severities(records: DataFrame) -> DataFrame:
    """Failed checks by severity, in all, and records with any."""
    own = {s: reduce(add, (F.col(n) for n, _, severity, _ in checks() if severity == s)) for s in ("critical", "warning", "info")}
    return _counted(records).select(*(c.alias(s) for s, c in own.items()), reduce(add, own.values()).alias("instances"), "affected")


def issue_records(records: DataFrame, severity: str | None = None, check: str | None = None, search: str = "") -> DataFrame:
    """Records with failed checks, worst first, then in source order: worst severity, sorted list of checks; optionally
    filtered."""
    known = list(enumerate(checks()))
    any_of = lambda own: F.col("__failed").bitwiseAND(sum(1 << i for i, (n, _, s, _) in known if own(n, s))) != 0
    f = _with_duplicate(records)
    f = f.withColumn("__failed", reduce(lambda a, b: a.bitwiseOR(b), (F.when(c, F.lit(1 << i)).otherwise(0) for i, (*_, c) in known))).drop("__duplicate").where("__failed <> 0")
    f = f.withColumn("severity_rank", F.when(any_of(lambda n, s: s == "critical"), 3).when(any_of(lambda n, s: s == "warning"), 2).otherwise(1))
    if severity:
        f = f.where(any_of(lambda n, s: s == severity))
    if check:
        f = f.where(any_of(lambda n, s: n == check))
    if search:
        f = f.where(F.lower("normalized_product_name").contains(search.lower()) | F.lower("item_id").contains(search.lower()))
    f = f.orderBy(F.col("severity_rank").desc(), "dataset_id", "_sheet_name", "_source_row")  # a number stands for what failed
    hit = lambda i: F.col("__failed").bitwiseAND(1 << i) != 0
    made = F.array_compact(F.array(*(F.when(hit(i), F.struct(F.lit(n).alias("check"), F.lit(d).alias("dim"), F.lit(s).alias("severity"))) for i, (n, d, s, _) in known)))
    return f.withColumns({"failed": made, "labels": F.concat_ws(",", *(F.when(hit(i), F.lit(n)) for i, (n, *_) in sorted(known, key=lambda x: x[1][0])))}).drop("__failed")
