"""Whether stock can be sold: signals of status words, the record's status, reconciliation by status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lotwise.functions import text as X
from lotwise.functions.units import strip_price
from lotwise.sources.tables import once_for_each

#: Words and phrases of a status, as they read after X.status_text.
SELLABLE = (
    "saleable", "salable", "sellable", "active", "active stock", "activestock", "good", "good condition", "goodcondition", "available", "available stock", "availablestock", "usable", "usable stock",
    "in stock", "instock", "prime", "sound", "fresh", "standard", "ok", "ready for sale", "ready to sell", "serviceable", "normal", "sellable inventory", "saleable inventory",
)
NON_SELLABLE = (
    "non saleable", "nonsaleable", "non saleable stock", "nonsaleable stock", "non saleable inventory", "non sellable", "non sellable stock", "non sellable inventory",
    "unsellable", "unsaleable", "non active", "inactive", "unserviceable",
)
#: A word directly in front of a signal that takes it back.
NEGATIONS = ("no", "not", "non", "un", "never", "without", "nil", "zero")
#: What sheet names say.
SHEET_NON_SELLABLE = ["non saleable", "nonsaleable", "non-saleable", "non sellable", "unsellable", "unsaleable"]
SHEET_SELLABLE_IS = ["saleable", "salable", "sellable"]
SHEET_SELLABLE_HAS = ["( saleable )", "( sellable )", "sellable inventory", "saleable inventory", "active stock", "available stock"]
#: The fields that may carry a signal, most telling first.
FIELDS = ["inventory_status", "item_type", "remarks", "condition", "disposition"]
#: The columns that resolve_status adds.
ADDED = {"status", "status_confidence", "status_source", "status_rule", "is_status_conflict", "status_conflict_reason"}


def has_signal(text: Column, words: list[str]) -> Column:
    """Whether a status word stands in the text between spaces or at its ends, without a negation directly before it.

    A text that is nothing but a status word always counts."""
    spelt = "|".join(w.replace(" ", r"\s+") for w in sorted(words, key=len, reverse=True))
    free = "".join(rf"(?<!(?:^|\s){n}\s{{1,9}})" for n in NEGATIONS)
    return text.isin(*words) | text.rlike(rf"(?:^|(?<=\s)){free}(?:{spelt})(?=$|\s)")


def sheet_signal(sheet: Column) -> Column:
    """non_sellable, sellable or null, from a normalised sheet name."""
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: sheet.contains(w))
    return F.when(has(SHEET_NON_SELLABLE), "non_sellable").when(sheet.isin(*SHEET_SELLABLE_IS) | has(SHEET_SELLABLE_HAS), "sellable")


def resolve_status(records: DataFrame) -> DataFrame:
    """Adds status, status_confidence, status_source, status_rule, is_status_conflict and status_conflict_reason.

    Row fields beat the sheet's name, which beats the default, sellable. Signals of both kinds in a row are a conflict
    and leave the status unknown. Damage or expiry words say nothing here. The fields repeat, so the rules are asked
    once for each combination of fields and sheet.
    """
    return once_for_each(records, ["_sheet_name", *(f for f in FIELDS if f in records.columns)], _by_signals)


def _by_signals(records: DataFrame) -> DataFrame:
    signals = []
    r = records.withColumns({f"__t_{name}": X.status_text(name) for name in FIELDS if name in records.columns})
    for name in FIELDS:
        t = F.col(f"__t_{name}") if name in records.columns else F.lit("")
        blank = t.isin("", "unknown", "null", "na")
        signals.append(F.struct(F.lit(name).alias("name"), (~blank & has_signal(t, NON_SELLABLE)).alias("bad"), (~blank & has_signal(t, SELLABLE)).alias("good")))
    r = r.withColumn("__s", F.array(*signals))
    r = r.withColumns({"__bad": F.get(F.filter("__s", lambda x: x["bad"]), F.lit(0))["name"], "__good": F.get(F.filter("__s", lambda x: x["good"]), F.lit(0))["name"], "__sheet": sheet_signal(X.status_text("_sheet_name"))})
    bad, good, sheet = F.col("__bad"), F.col("__good"), F.col("__sheet")
    conflict = bad.isNotNull() & good.isNotNull()
    pick = lambda both, b, g, s, d: F.when(conflict, both).when(bad.isNotNull(), b).when(good.isNotNull(), g).when(sheet.isNotNull(), s).otherwise(d)
    r = r.withColumns(
        {
            "status": pick(F.lit("unknown"), F.lit("non_sellable"), F.lit("sellable"), sheet, F.lit("sellable")),
            "status_confidence": pick(F.lit("LOW"), F.lit("HIGH"), F.lit("HIGH"), F.lit("HIGH"), F.lit("MEDIUM")),
            "status_source": pick(F.lit("conflict_unresolved"), bad, good, F.lit("sheet_context"), F.lit("default_fallback")),
            "status_rule": pick(F.lit("semantic_status_conflict"), F.lit("explicit_row_non_sellable"), F.lit("explicit_row_sellable"), F.concat(F.lit("sheet_context_"), sheet), F.lit("default_sellable")),
            "is_status_conflict": conflict,
            "status_conflict_reason": F.when(conflict, F.concat(F.lit("both signals: sellable in "), good, F.lit(", non-sellable in "), bad)),
        }
    )
    return r.drop("__s", "__bad", "__good", "__sheet", *(f"__t_{name}" for name in FIELDS))


def reconcile_status(records: DataFrame, *by: str) -> DataFrame:
    """Records, units and value by status and in all, and whether the parts add up (within 0.05), by given columns."""
    units, value = X.finite("qty"), X.finite("source_value")
    out = [F.count("*").alias("records"), F.round(F.sum(units), 2).alias("units"), F.round(F.sum(value), 2).alias("value")]
    for s in ("sellable", "non_sellable", "unknown"):
        mine = F.col("status") == s
        out += [F.count_if(mine).alias(f"{s}_records"), F.round(F.coalesce(F.sum(F.when(mine, units)), F.lit(0.0)), 2).alias(f"{s}_units"), F.round(F.coalesce(F.sum(F.when(mine, value)), F.lit(0.0)), 2).alias(f"{s}_value")]
    parts = lambda m: F.abs(F.col(m) - F.col(f"sellable_{m}") - F.col(f"non_sellable_{m}") - F.col(f"unknown_{m}")) < 0.05
    return records.groupBy(*by).agg(*out, F.count_if("is_status_conflict").alias("conflicted")).withColumn("reconciled", parts("records") & parts("units") & parts("value"))


def row_filter(records: DataFrame, column: str = "inventory_status") -> DataFrame:
    """The row cleaner's simpler verdict, from one status column and the sheet's name: adds row_status.

    Non-sellable wins; blank falls to the sheet, where dump counts as non-sellable; never unknown.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(X.trimmed(c)), r"[^a-z0-9-]", " "), r"\s+", " "))
    t, sheet = plain(column), plain("_sheet_name")
    unsold = r"non[ -]?(?:saleable|sellable|salable)|unsaleable|unsellable"
    bad, good, sheet_bad = t.rlike(rf"\b(?:{unsold})\b"), t.rlike(r"\b(?:saleable|sellable|salable)\b"), sheet.rlike(rf"{unsold}|dump")
    return records.withColumn("row_status", F.when(bad, "non_sellable").when(good, "sellable").when(sheet_bad, "non_sellable").otherwise("sellable"))


def kept_rows(records: DataFrame, strip_prices: tuple[str, ...] = ()) -> DataFrame:
    """The rows that can be sold, marked so; embedded prices go from the given variant and pack columns."""
    kept = row_filter(records).where("row_status = 'sellable'").withColumn("Remark", F.lit("Saleable"))
    return kept.withColumns({c: F.when(F.col(c).isNotNull(), strip_price(c)) for c in strip_prices}) if strip_prices else kept


def removed_rows(records: DataFrame) -> DataFrame:
    return row_filter(records).where("row_status = 'non_sellable'")


def row_filter_report(records: DataFrame) -> DataFrame:
    """Kept and removed rows by sheet and in all (sheet null), with shares; kept + removed = source."""
    counts = row_filter(records).groupingSets([["_sheet_name"], []], "_sheet_name").agg(
        F.count("*").alias("source_rows"), F.count_if(F.col("row_status") == "sellable").alias("kept"), F.count_if(F.col("row_status") != "sellable").alias("removed")
    )
    return counts.withColumns({"kept_pct": F.round(100 * F.col("kept") / F.col("source_rows"), 1), "balanced": F.col("kept") + F.col("removed") == F.col("source_rows")})
