"""Units: pack sizes, masses, volumes and embedded prices in text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from lotwise.functions.text import col, trimmed

NUMBER = r"(\d+(?:\.\d+)?)"
#: Spellings of units.
SPELLINGS = {
    "KG": "kg kgs kilogram kilograms",
    "G": "g gm gms gram grams",
    "L": "l lt ltr ltrs liter litres litre",
    "ML": "ml milliliter millilitres",
    "PCS": "pc pcs piece pieces",
    "PACK": "pk pack packs pkt packet",
    "UNIT": "unit units",
    "BOX": "box boxes",
    "BOTTLE": "btl bottle bottles",
    "CAN": "can cans",
    "TIN": "tin tins",
    "JAR": "jar jars",
    "POUCH": "pouch pouches",
    "BAG": "bag bags sack sacks",
    "ROLL": "roll rolls",
    "STRIP": "strip strips",
    "SACHET": "sachet sachets",
    "SET": "set sets",
    "PAIR": "pair pairs",
}
#: Units looked for in product names, and what they count as.
NAME_UNITS = {"kg": "KG", "kgs": "KG", "g": "G", "gm": "G", "gms": "G", "l": "L", "ltr": "L", "ml": "ML", "pcs": "PCS", "pack": "PCS", "pk": "PCS", "unit": "PCS", "units": "PCS"}


def any_of(unit: str) -> str:
    return "(?:" + "|".join(SPELLINGS[unit].split()) + ")"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(pairs.items())))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """What a group of a pattern matches, or null."""
    x = F.regexp_extract(c, pattern, group)
    return F.when(x != "", x)


def strip_price(c: Column | str) -> Column:
    """Without price parts (`- Rs 749.0`, or a bare `- 480` that no word follows).

    The number is matched possessively, so that `10 kg - 12 pack` keeps its count.
    """
    c = F.regexp_replace(trimmed(c), r"(?i)\s*-\s*Rs\.?\s*\d+(?:\.\d+)?", "")
    return trimmed(F.regexp_replace(c, r"\s*-\s*\d++(?:\.\d++)?+(?!\s*[a-zA-Z])", ""))


def _pack(size: Column, unit: Column) -> Column:
    return F.struct(F.concat(size, F.lit(" "), unit).alias("normalized_uom"), size.cast("double").alias("uom_size"), unit.alias("uom_type"))


def pack_of_text(text: Column | str) -> Column:
    """The pack that a unit text is, or null."""
    raw = trimmed(text)
    known = _map({s: u for u, words in SPELLINGS.items() for s in words.split()})
    size, unit = found(raw, rf"(?i)^{NUMBER}\s*([a-z]+)$"), known[F.lower(F.regexp_extract(raw, rf"(?i)^{NUMBER}\s*([a-z]+)$", 2))]
    return F.when(size.isNotNull() & unit.isNotNull(), _pack(size, unit))


def pack_in_name(name: Column | str) -> Column:
    """The pack of the first size in a name, or null."""
    in_name = rf"(?i){NUMBER}\s*({'|'.join(NAME_UNITS)})\b"
    size, unit = found(col(name), in_name), _map(NAME_UNITS)[F.lower(F.regexp_extract(col(name), in_name, 2))]
    return F.when(size.isNotNull(), _pack(size, unit))


def pack_as_it_is(text: Column | str) -> Column:
    raw = trimmed(text)
    return F.struct(F.when(raw == "", F.lit("1 Unit")).otherwise(raw).alias("normalized_uom"), F.lit(1.0).alias("uom_size"), F.lit("UNIT").alias("uom_type"))


def pack_size(text: Column | str, name: Column | str) -> Column:
    """(normalized_uom, uom_size, uom_type) of a unit text, else of the first size in the name, else as it is."""
    return F.coalesce(pack_of_text(text), pack_in_name(name), pack_as_it_is(text))


def header_unit(c: Column | str) -> Column:
    """KG, G, L or ML if a header names it."""
    c = F.lower(col(c))
    out = F.lit(None).cast("string")
    for unit, short in (("ML", "ml"), ("L", "l"), ("G", "g"), ("KG", "kg")):
        spelt = any_of(unit) if unit != "ML" else "ml"
        out = F.when(c.rlike(rf"\b{spelt}\b|_{short}|\({short}\)"), F.lit(unit)).otherwise(out)
    return out


def weight_value(c: Column | str, unit: Column | str | None = None) -> Column:
    """(raw_value, unit, value_kg, provenance) of a weight cell; null for blanks, volumes and other text.

    ``unit`` is what the column's header says: a bare number without it has no known unit.
    """
    s = trimmed(c)
    kg, g = (found(s, rf"(?i)^([\d.]+)\s*{any_of(u)}$").try_cast("double") for u in ("KG", "G"))
    bare = F.regexp_replace(s, ",", "").try_cast("double")
    unit = F.lit(None).cast("string") if unit is None else col(unit)
    made = lambda v, u, k, p: F.struct(v.alias("raw_value"), F.lit(u).alias("unit"), k.cast("double").alias("value_kg"), F.lit(p).alias("provenance"))
    volume = s.rlike(rf"(?i)^([\d.]+)\s*(?:{any_of('L')}|{any_of('ML')})$")
    return (
        F.when((s == "") | (s == "-"), F.lit(None))
        .when(kg.isNotNull(), made(kg, "KG", kg, "source_explicit"))
        .when(g.isNotNull(), made(g, "G", g / 1000, "source_explicit"))
        .when(volume | bare.isNull() | F.isnan(bare), F.lit(None))
        .when(unit == "KG", made(bare, "KG", bare, "source_schema"))
        .when(unit == "G", made(bare, "G", bare / 1000, "source_schema"))
        .otherwise(made(bare, "UNKNOWN", F.lit(None), "unknown"))
    )


def _amount(c: Column | str, large: str, small: str) -> Column:
    s = col(c)
    def times(unit: str) -> Column:
        p = rf"(?i)\b{NUMBER}\s*(?:x|\*)\s*{NUMBER}\s*{any_of(unit)}\b"
        return found(s, p).cast("double") * found(s, p, 2).cast("double")
    one = lambda unit: found(s, rf"(?i)\b{NUMBER}\s*{any_of(unit)}\b").cast("double")
    some = s.rlike(rf"(?i)[0-9]\s*(?:{any_of(large)}|{any_of(small)})\b")  # most texts stop here
    return F.when(some, F.coalesce(times(large), times(small) / 1000, one(large), one(small) / 1000))


def mass_kg(*texts: Column | str) -> Column:
    """Kilograms named in the first text that names a mass, multipacks multiplied out."""
    return F.coalesce(*(_amount(t, "KG", "G") for t in texts))


def volume_l(*texts: Column | str) -> Column:
    """Litres named in the first text that names a volume. Never counts as mass."""
    return F.coalesce(*(_amount(t, "L", "ML") for t in texts))
