"""The same results in plain SQL, for comparison in another engine. Rules and word lists come from the same data;
the logic is written again."""

from __future__ import annotations

from lotwise.functions import text as X, units as U, vocabulary as V
from lotwise.operators import audit, clean as C, status as S
from lotwise.operators.category import pattern
from lotwise.sources.inventory import INVENTORY_SQL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def spaced(x: str) -> str:
    return trim(rf"regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g')")


def lowered(x: str, separators: str = r"[\-_]") -> str:
    return rf"regexp_replace(regexp_replace(lower({trim(x)}), '{separators}', ' ', 'g'), '\s+', ' ', 'g')"


def title(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({trim(x)}), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


def number(x: str) -> str:
    return rf"TRY_CAST(regexp_replace({x}, '[^0-9.\-]', '', 'g') AS DOUBLE)"


def found(x: str, p: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {q(p)}, {group}), '')"


def case(pairs: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {otherwise} END" if pairs else otherwise


def amount(x: str, large: str, small: str) -> str:
    s = f"lower(coalesce({x}, ''))"
    def times(u: str) -> str:
        p = rf"\b{U.NUMBER}\s*(?:x|\*)\s*{U.NUMBER}\s*{U.any_of(u)}\b"
        return f"CAST({found(s, p)} AS DOUBLE) * CAST({found(s, p, 2)} AS DOUBLE)"
    one = lambda u: f"CAST({found(s, rf'\b{U.NUMBER}\s*{U.any_of(u)}\b')} AS DOUBLE)"
    return f"coalesce({times(large)}, {times(small)} / 1000, {one(large)}, {one(small)} / 1000)"


def weight(x: str, part: str) -> str:
    s = trim(x)
    kg, g = (f"TRY_CAST({found(s, rf'(?i)^([\d.]+)\s*{U.any_of(u)}$')} AS DOUBLE)" for u in ("KG", "G"))
    volume = f"regexp_matches({s}, {q(rf'(?i)^([\d.]+)\s*(?:{U.any_of('L')}|{U.any_of('ML')})$')})"
    bare = f"TRY_CAST(replace({s}, ',', '') AS DOUBLE)"
    value = {"raw": (kg, g, bare), "unit": ("'KG'", "'G'", "'UNKNOWN'"), "kg": (kg, f"{g} / 1000", "NULL"), "provenance": ("'source_explicit'", "'source_explicit'", "'unknown'")}[part]
    return f"CASE WHEN {s} IN ('', '-') THEN NULL WHEN {kg} IS NOT NULL THEN {value[0]} WHEN {g} IS NOT NULL THEN {value[1]} WHEN {volume} OR {bare} IS NULL THEN NULL ELSE {value[2]} END"


def sheet_kind(x: str) -> str:
    s = lowered(x)
    return case([(" OR ".join(f"contains({s}, {q(w)})" for w in words), q(kind)) for words, kind in C.SHEET_KINDS])


def signal(t: str, words: list[str]) -> str:
    """RE2 has no look-behind: words with a negation in front are taken out first."""
    spelt = "|".join(w.replace(" ", r"\s+") for w in sorted(words, key=len, reverse=True))
    free = rf"regexp_replace({t}, '(^|\s)({'|'.join(S.NEGATIONS)})\s+({spelt})($|\s)', ' # ', 'g')"
    return rf"({t} IN ({', '.join(map(q, words))}) OR regexp_matches({free}, '(^|\s)({spelt})($|\s)'))"


def _pack(uom: str, name: str) -> tuple[str, str]:
    known = case([(f"lower(regexp_extract({uom}, {q(rf'(?i)^{U.NUMBER}\s*([a-z]+)$')}, 2)) IN ({', '.join(map(q, words.split()))})", q(u)) for u, words in U.SPELLINGS.items()])
    size = found(uom, rf"(?i)^{U.NUMBER}\s*([a-z]+)$")
    in_name = rf"(?i){U.NUMBER}\s*({'|'.join(U.NAME_UNITS)})\b"
    n_unit = case([(f"lower(regexp_extract({name}, {q(in_name)}, 2)) = {q(k)}", q(v)) for k, v in U.NAME_UNITS.items()])
    n_size = found(name, in_name)
    return (
        f"CASE WHEN {size} IS NOT NULL AND {known} IS NOT NULL THEN {size} || ' ' || {known} WHEN {n_size} IS NOT NULL THEN {n_size} || ' ' || {n_unit} WHEN {uom} = '' THEN '1 Unit' ELSE {uom} END",
        f"CASE WHEN {size} IS NOT NULL AND {known} IS NOT NULL THEN {known} WHEN {n_size} IS NOT NULL THEN {n_unit} ELSE 'UNIT' END",
    )


def strip_price(x: str) -> str:
    """Without look-ahead: the bare number goes only at the end or before what is no letter."""
    one = rf"regexp_replace({trim(x)}, '(?i)\s*-\s*Rs\.?\s*\d+(?:\.\d+)?', '', 'g')"
    return trim(rf"regexp_replace({one}, '\s*-\s*\d+(?:\.\d+)?(\s*$|\s*[^\sa-zA-Z0-9.])', '\1', 'g')")


_first = f"string_split({trim('name')}, ' ')[1]"
_raw_brand = f"CASE WHEN {trim('brand')} <> '' THEN {trim('brand')} WHEN length({_first}) > 2 THEN {_first} END"
_bare_brand = rf"regexp_replace({_raw_brand}, '(?i)\s*(" + "|".join(X.LEGAL_ENDINGS) + ")$', '')"
_words = ", ".join(map(q, X.BRAND_NOISE))
_uom, _unit = _pack("pack_text", trim("name"))

CLEAN_SQL = f"""inv AS ({INVENTORY_SQL}),
c1 AS (SELECT *, {trim('entity_name')} AS raw_entity_name, {trim('brand')} AS raw_brand, {trim('l0')} AS raw_category, {trim('name')} AS raw_product_name, {trim('remarks')} AS raw_remarks,
  CASE WHEN {trim('inventory_status')} = '' AND ({signal(f"lower({trim('remarks')})", S.SELLABLE)} OR {signal(f"lower({trim('remarks')})", S.NON_SELLABLE)}) THEN {trim('remarks')} ELSE {trim('inventory_status')} END AS eff_status,
  coalesce({sheet_kind('_sheet_name')}, 'unknown') AS raw_bad_inventory_type,
  coalesce({number('qty')}, 0) AS n_qty, {number('variant_mrp')} AS mrp,
  CASE WHEN value_is_numeric AND TRY_CAST(value AS DOUBLE) = 0 THEN NULL ELSE {number('value')} END AS n_value,
  {weight('total_weight', 'raw')} AS t_raw, {weight('total_weight', 'unit')} AS t_unit, {weight('total_weight', 'kg')} AS t_kg, {weight('weight', 'raw')} AS u_raw, {weight('weight', 'unit')} AS u_unit, {weight('weight', 'kg')} AS u_kg,
  CASE WHEN {trim('variant_uom_text')} <> '' THEN {trim('variant_uom_text')} ELSE {trim('weight')} END AS uom_text FROM inv),
c2 AS (SELECT *, coalesce(n_value, CASE WHEN n_qty > 0 THEN mrp * n_qty END, 0) AS source_value,
  coalesce({amount('uom_text', 'KG', 'G')}, {amount('raw_product_name', 'KG', 'G')}) AS mass,
  coalesce({amount('uom_text', 'L', 'ML')}, {amount('raw_product_name', 'L', 'ML')}, 0) AS unit_volume_l, {strip_price('uom_text')} AS pack_text,
  CASE WHEN t_raw > 0 AND t_unit IN ('KG', 'G') THEN t_kg END AS source_total_weight_kg,
  CASE WHEN NOT coalesce(t_raw > 0, false) AND u_raw > 0 AND u_unit IN ('KG', 'G') THEN u_kg * n_qty END AS derived_source_weight_kg FROM c1),
c3 AS (SELECT *, CASE WHEN source_total_weight_kg IS NULL AND derived_source_weight_kg IS NULL AND mass > 0 THEN mass * n_qty END AS derived_name_mass_kg FROM c2),
cl AS (SELECT dataset_id, _sheet_name, _source_row, name, item_id, upc, variant_id, raw_brand, raw_category AS source_category, raw_product_name, raw_entity_name, eff_status AS inventory_status, item_type, remarks, condition, disposition, raw_bad_inventory_type, raw_remarks,
  CASE WHEN raw_entity_name = '' THEN 'Unknown Warehouse' ELSE {title('raw_entity_name')} END AS normalized_warehouse,
  CASE WHEN raw_product_name = '' THEN 'Unnamed Product' ELSE {title(spaced('raw_product_name'))} END AS normalized_product_name,
  coalesce(CASE WHEN {_raw_brand} IS NOT NULL THEN {title(spaced(_bare_brand))} END, 'Unknown Brand') AS normalized_brand,
  n_qty AS qty, mrp AS variant_mrp, source_value, unit_volume_l, CASE WHEN unit_volume_l > 0 THEN unit_volume_l * n_qty ELSE 0 END AS total_volume_l,
  source_total_weight_kg, derived_source_weight_kg, derived_name_mass_kg, coalesce(source_total_weight_kg, derived_source_weight_kg, derived_name_mass_kg, 0) AS total_weight,
  CASE WHEN derived_name_mass_kg IS NOT NULL THEN 'derived_mass_uom' WHEN source_total_weight_kg IS NOT NULL THEN 'source_total_weight' WHEN derived_source_weight_kg IS NOT NULL THEN 'source_unit_weight_qty' ELSE 'unavailable' END AS weight_source,
  CASE WHEN t_raw > 0 AND u_raw > 0 THEN CASE WHEN t_unit IN ('KG', 'G') AND u_unit IN ('KG', 'G') THEN CASE WHEN abs(t_kg - u_kg * n_qty) < 1e-5 THEN 'EXACT' WHEN abs(t_kg - u_kg * n_qty) <= 0.01 OR abs(t_kg - u_kg * n_qty) / greatest(t_kg, 1) < 0.005 THEN 'MINOR_ROUNDING' ELSE 'MATERIAL_MISMATCH' END ELSE 'UNKNOWN_UNIT' END
       WHEN derived_source_weight_kg IS NOT NULL THEN 'EXACT' ELSE 'N/A' END AS weight_validation_status,
  CASE WHEN source_total_weight_kg > 0 THEN 'VERIFIED' WHEN derived_source_weight_kg > 0 OR derived_name_mass_kg > 0 THEN 'DERIVED' WHEN unit_volume_l * n_qty > 0 THEN 'NOT_APPLICABLE' WHEN n_qty > 0 AND (weight IS NOT NULL OR total_weight IS NOT NULL) THEN 'UNKNOWN' ELSE 'NOT_APPLICABLE' END AS mass_status,
  {_uom} AS normalized_uom, {_unit} AS uom_type FROM c3)"""


def _sheet_signal(x: str) -> str:
    s = lowered(x, r"[\-_/]")
    bad = " OR ".join(f"contains({s}, {q(w)})" for w in S.SHEET_NON_SELLABLE)
    good = " OR ".join([f"{s} IN ({', '.join(map(q, S.SHEET_SELLABLE_IS))})", *(f"contains({s}, {q(w)})" for w in S.SHEET_SELLABLE_HAS)])
    return f"CASE WHEN {bad} THEN 'non_sellable' WHEN {good} THEN 'sellable' END"


def _source(words: list[str]) -> str:
    pairs = []
    for f in S.FIELDS:
        t = lowered(f, r"[\-_/]")
        pairs.append((f"{t} NOT IN ('', 'unknown', 'null', 'na') AND {signal(t, words)}", q(f)))
    return case(pairs)


STATUS_SQL = f"""{CLEAN_SQL},
s1 AS (SELECT *, {_source(S.NON_SELLABLE)} AS bad, {_source(S.SELLABLE)} AS good, {_sheet_signal('_sheet_name')} AS sheet_says FROM cl),
st AS (SELECT *, bad IS NOT NULL AND good IS NOT NULL AS is_status_conflict,
  CASE WHEN bad IS NOT NULL AND good IS NOT NULL THEN 'unknown' WHEN bad IS NOT NULL THEN 'non_sellable' WHEN good IS NOT NULL THEN 'sellable' ELSE coalesce(sheet_says, 'sellable') END AS status,
  CASE WHEN bad IS NOT NULL AND good IS NOT NULL THEN 'LOW' WHEN bad IS NOT NULL OR good IS NOT NULL OR sheet_says IS NOT NULL THEN 'HIGH' ELSE 'MEDIUM' END AS status_confidence,
  CASE WHEN bad IS NOT NULL AND good IS NOT NULL THEN 'conflict_unresolved' WHEN bad IS NOT NULL THEN bad WHEN good IS NOT NULL THEN good WHEN sheet_says IS NOT NULL THEN 'sheet_context' ELSE 'default_fallback' END AS status_source,
  CASE WHEN bad IS NOT NULL AND good IS NOT NULL THEN 'semantic_status_conflict' WHEN bad IS NOT NULL THEN 'explicit_row_non_sellable' WHEN good IS NOT NULL THEN 'explicit_row_sellable' WHEN sheet_says IS NOT NULL THEN 'sheet_context_' || sheet_says ELSE 'default_sellable' END AS status_rule FROM s1)"""


def has(x: str, words: V.Words) -> str:
    return f"regexp_matches({x}, {q(pattern(words))})" if words else "false"


def ways(m: V.Match, name: str, brand: str) -> str:
    parts = [has(name, m.words), has(brand, m.brands)]
    for a in m.also:
        parts.append(" AND ".join([has(name, a.words), *([has(name, a.together)] if a.together else []), f"NOT {has(name, a.without)}"]))
    return "(" + " OR ".join(f"({p})" for p in parts) + ")"


def one_of(x: str, values: V.Words) -> str:
    return f"{x} IN ({', '.join(map(q, values))})" if values else "false"


def _score(keywords: V.Words) -> str:
    def found(kept: list[str], holds: str) -> str:
        return f"coalesce(list_sum(list_transform(list_filter([{', '.join(map(q, kept))}], lambda k: {holds}), lambda k: length(k))), 0)" if kept else "0"
    plain, whole = [k for k in keywords if not k.startswith(chr(92))], [k[2:-2] for k in keywords if k.startswith(chr(92))]
    return found(plain, "contains(both_text, k)") + " + " + found(whole, "list_contains(both_words, k)")


def _best() -> str:
    out = []
    for cat in dict.fromkeys(c for c, _, _ in V.TAXONOMY):
        own = [(s, k) for c, s, k in V.TAXONOMY if c == cat]
        scored = ", ".join(f"{{'score': {_score(k)}, 'at': {-i}, 'sub': {q(s)}}}" for i, (s, k) in enumerate(own))
        out.append((f"main = {q(cat)}", f"list_max([{scored}]).sub"))
    return f"coalesce({case(out)}, 'General')"


_none = ", ".join(map(q, V.NO_CATEGORIES))
_plain = spaced(rf"regexp_replace(raw0, '[()_\-\[\]]', ' ', 'g')")
_known = list(dict.fromkeys(c for c, _, _ in V.TAXONOMY))
_rules = [
    (f"({ways(r.match, 'name_text', 'brand_text')} OR {one_of('raw', r.match.sources)}) AND NOT {has('name_text', r.match.without)}" + (f" AND {one_of('raw', r.gate)}" if r.gate is not None else ""), r)
    for r in V.DOMAIN_RULES
]
_flag = {f.subcategory: f"f{i}" for i, f in enumerate(V.FOOD_RULES)}
_foods = ""
_last = "k2"
for _i, _f in enumerate(V.FOOD_RULES):
    _given = " AND ".join([one_of("raw", _f.match.sources), *(f"NOT {_flag[o]}" for o in _f.sources_not_if)])
    _not = "".join(f" AND NOT {_flag[o]}" for o in _f.not_if)
    _foods += f", z{_i} AS (SELECT *, ({ways(_f.match, 'name_text', 'brand_text')} OR ({_given})) AND NOT {has('name_text', _f.match.without)}{_not} AS f{_i} FROM {_last})"
    _last = f"z{_i}"

CATEGORY_SQL = rf"""{STATUS_SQL},
k0 AS (SELECT *, lower({trim('source_category')}) AS raw0, lower({trim('normalized_product_name')}) AS name_text, lower({trim('normalized_brand')}) AS brand_text, lower(trim(normalized_product_name || ' ' || normalized_brand)) AS both_text FROM (SELECT DISTINCT source_category, normalized_product_name, normalized_brand FROM st)),
k1 AS (SELECT *, CASE WHEN raw0 IN ({_none}) OR {_plain} IN ({_none}) OR regexp_matches(raw0, '^(sheet\s*\d+|lot[\s-]*\d+)$') OR len(list_filter(string_split({_plain}, ' '), lambda w: NOT (w IN ({_none}) OR regexp_matches(w, '^\d+$')))) = 0 THEN '' ELSE raw0 END AS raw FROM k0),
k2 AS (SELECT *, {case([(f"raw = {q(k)}", q(c)) for k, (c, _) in V.RAW_CATEGORIES.items()])} AS mapped_cat, {case([(f"raw = {q(k)}", q(s) if s else 'NULL') for k, (_, s) in V.RAW_CATEGORIES.items()])} AS mapped_sub,
  {case([(f"raw = {q(c.lower())} AND raw NOT IN ({', '.join(map(q, V.RAW_CATEGORIES))})", q(c)) for c in _known])} AS given,
  {case([(c, q(r.name)) for c, r in _rules])} AS d_rule, {case([(c, q(r.category)) for c, r in _rules])} AS d_cat,
  {case([(c, case([(has('name_text', w), q(s)) for s, w in r.subcategories], q(r.otherwise))) for c, r in _rules])} AS d_sub FROM k1){_foods},
k3 AS (SELECT *, {case([(f"f{i}", q(f.subcategory)) for i, f in enumerate(V.FOOD_RULES)])} AS food, CASE WHEN NOT {one_of('given', V.UNLOCKED)} THEN given END AS locked FROM {_last}),
k4 AS (SELECT *, coalesce(locked, d_cat, CASE WHEN food IS NOT NULL THEN 'Grocery' END, mapped_cat, given, CASE WHEN raw <> '' THEN array_to_string(list_transform(regexp_extract_all({spaced('source_category')}, '(\w+|\W+)'), lambda w: upper(w[1:1]) || w[2:]), '') END, 'Other / Uncategorized') AS main FROM k3),
k5a AS (SELECT *, regexp_split_to_array(both_text, '[^a-z0-9]+') AS both_words FROM k4),
k5 AS (SELECT *, {_best()} AS keyword FROM k5a),
kc AS (SELECT source_category, normalized_product_name, normalized_brand, locked, d_rule, main, main AS normalized_category, CASE WHEN locked IS NOT NULL THEN keyword ELSE coalesce(d_sub, food, mapped_sub, keyword) END AS subcategory,
  regexp_matches(name_text, {q(pattern(V.AMBIGUOUS))}) AS is_ambiguous FROM k5),
ct AS (SELECT st.*, kc.* EXCLUDE (source_category, normalized_product_name, normalized_brand) FROM st JOIN kc USING (source_category, normalized_product_name, normalized_brand)),
cat AS (SELECT *, CASE WHEN locked IS NOT NULL OR d_rule IS NOT NULL THEN 'HIGH' WHEN main = 'Other / Uncategorized' THEN 'LOW' WHEN subcategory IN ('General', 'General Staples') THEN 'MEDIUM' ELSE 'HIGH' END AS subcategory_confidence,
  CASE WHEN locked IS NOT NULL THEN 'explicit_domain_lock' WHEN d_rule IS NOT NULL THEN d_rule WHEN main = 'Other / Uncategorized' THEN 'default_fallback' WHEN subcategory IN ('General', 'General Staples') THEN 'category_general_fallback' ELSE 'identity_priority_match' END AS classification_rule FROM ct)"""

_fp = rf"array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(normalized_brand), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> '' AND w NOT IN ({_words}))), ' ')"
BRAND_SQL = f"""{CATEGORY_SQL},
bf AS (SELECT *, CASE WHEN {_fp} <> '' THEN {_fp} ELSE lower(trim(normalized_brand)) END AS brand_fingerprint FROM cat)"""

_bare = lowered("normalized_product_name", r"\s")
for _p in (rf"\b\d+\s*x\s*\d+(?:\.\d+)?\s*(?:{'|'.join(X.MULTIPACK_UNITS)})\b", rf"\b\d+(?:\.\d+)?\s*(?:{'|'.join(X.SIZE_UNITS)})\b", rf"\((?:{'|'.join(X.PACKAGING)})\)"):
    _bare = f"regexp_replace({_bare}, {q(_p)}, '', 'g')"
_bare = spaced(rf"regexp_replace({_bare}, '[-_(),\[\]]', ' ', 'g')")
_tokens = rf"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array({_bare}, '\W+'), lambda w: length(w) > 1 AND w NOT IN ({', '.join(map(q, X.NAME_STOP_WORDS))})))), ' ')"
_model = rf"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({trim('normalized_product_name')}), '[-_]', ' ', 'g'), '\s+'), lambda w: regexp_matches(w, {q(X.MODEL_WORD)})))), ' ')"
_text = lambda c: f"coalesce(CAST({c} AS VARCHAR), '')"
#: Families: keys that share a component, and in a second pass components without a category that join one with the same
#: brand and words. Reachable pairs of keys are spelt out: components are small here.
FAMILY_SQL = f"""{BRAND_SQL},
bm AS (SELECT brand_fingerprint, arg_min(normalized_brand, (CASE WHEN length(normalized_brand) >= 3 THEN length(normalized_brand) ELSE 1073741824 END) * 1000000000000 + _source_row) AS canonical FROM bf GROUP BY 1),
nm AS (SELECT brand_fingerprint, normalized_category, normalized_product_name, {_tokens} AS tokens, {_model} AS model FROM (SELECT DISTINCT brand_fingerprint, normalized_category, normalized_product_name FROM bf)),
ks AS (SELECT bf.*, bm.canonical, CASE WHEN {trim('item_id')} <> '' THEN 'i:' || {trim('item_id')} END AS ki, CASE WHEN {trim('upc')} <> '' THEN 'u:' || {trim('upc')} END AS ku,
  CASE WHEN tokens <> '' THEN 'n:' || sha1(sha1(brand_fingerprint) || '|' || normalized_category || '|' || tokens || '|' || model) END AS kn, CASE WHEN tokens <> '' THEN tokens || '|' || model END AS kw
  FROM bf JOIN bm USING (brand_fingerprint) JOIN nm USING (brand_fingerprint, normalized_category, normalized_product_name)),
ed AS (SELECT DISTINCT coalesce(ki, ku, kn) AS a, unnest(list_filter([ki, ku, kn], lambda k: k IS NOT NULL)) AS b FROM ks WHERE coalesce(ki, ku, kn) IS NOT NULL),
e2 AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
r1(k, l) AS (SELECT a, a FROM e2 UNION SELECT r1.k, e2.b FROM r1 JOIN e2 ON e2.a = r1.l),
l1 AS (SELECT k, min(l) AS label FROM r1 GROUP BY 1),
nn AS (SELECT kn, kw, brand_fingerprint AS brand, normalized_category = 'Other / Uncategorized' AS open, min(row(dataset_id, _sheet_name, _source_row)) AS place FROM ks WHERE kn IS NOT NULL GROUP BY ALL),
nl AS (SELECT nn.*, label FROM nn JOIN l1 ON l1.k = nn.kn),
fu AS (SELECT label, min(open) AS open, row(min(place), label) AS rank FROM nl GROUP BY label),
fr AS (SELECT nl.label, nl.open, rank, kw, brand FROM nl JOIN fu ON fu.label = nl.label AND fu.open = nl.open),
ofr AS (SELECT kw, brand, min(rank) AS best FROM fr WHERE NOT open GROUP BY ALL),
mo AS (SELECT fr.label AS a, min(best)[2] AS b FROM fr JOIN ofr USING (kw, brand) WHERE fr.open GROUP BY 1),
e3 AS (SELECT a, b FROM e2 UNION SELECT a, b FROM mo UNION SELECT b, a FROM mo),
r2(k, l) AS (SELECT a, a FROM e3 UNION SELECT r2.k, e3.b FROM r2 JOIN e3 ON e3.a = r2.l),
l2 AS (SELECT k, min(l) AS label FROM r2 GROUP BY 1),
pf AS (SELECT ks.*, sha1(coalesce(label, 'r:' || dataset_id || ':' || _sheet_name || ':row_' || CAST(_source_row AS VARCHAR))) AS product_family_id FROM ks LEFT JOIN l2 ON l2.k = coalesce(ki, ku, kn)),
pv AS (SELECT *, sha1(product_family_id || '||' || {_text('variant_id')} || '||' || {_text('upc')} || '||' || {_text('normalized_uom')} || '||' || {_text('variant_mrp')}) AS product_variant_id FROM pf)"""
MASS_LABEL = "CASE weight_source WHEN 'source_total_weight' THEN 'Source total weight' WHEN 'source_unit_weight_qty' THEN 'Unit weight x quantity' WHEN 'derived_mass_uom' THEN 'Pack size x quantity' ELSE CASE WHEN total_volume_l > 0 THEN 'Volume only' ELSE 'Unavailable' END END"


def _norm(x: str) -> str:
    c = rf"regexp_replace(regexp_replace(lower({trim(x)}), '[&/]', ' and ', 'g'), '[^a-z0-9\x{{0900}}-\x{{097F}}\s]', ' ', 'g')"
    return spaced(rf"regexp_replace({c}, '\band\b', ' ', 'g')")


_synonyms = ", ".join(f"({q(kind)}, {q(name)}, 2, {q(term)})" for term, kind, name in V.SYNONYMS)
#: Terms, their words, and the entities that they may name.
ENTITIES = f""", tm AS (SELECT DISTINCT normalized_brand || ' ' || subcategory AS term FROM cat), tn AS (SELECT term, {_norm('term')} AS t FROM tm),
tw AS (SELECT term, t, w, min(place) AS place FROM (SELECT term, t, unnest(string_split(t, ' ')) AS w, unnest(range(len(string_split(t, ' ')))) AS place FROM tn WHERE t <> '') GROUP BY term, t, w),
en AS (SELECT *, {_norm('said')} AS norm FROM (SELECT DISTINCT 'category' AS kind, normalized_category AS name, 1 AS rank, normalized_category AS said FROM cat UNION ALL SELECT DISTINCT 'subcategory', subcategory, 3, subcategory FROM cat UNION ALL SELECT DISTINCT 'brand', normalized_brand, 4, normalized_brand FROM cat UNION ALL SELECT DISTINCT 'warehouse', normalized_warehouse, 9, normalized_warehouse FROM cat UNION ALL VALUES {_synonyms}) WHERE {_norm('said')} <> '')"""

MEASURES = "count(*) AS records, round(sum(qty), 2) AS units, round(sum(source_value), 2) AS value, round(sum(total_weight), 3) AS weight, round(sum(total_volume_l), 3) AS volume, count(DISTINCT item_id) AS skus, count(DISTINCT normalized_brand) AS brands"
KIND = "CASE WHEN coalesce(raw_bad_inventory_type, '') = '' THEN 'unknown' ELSE lower(raw_bad_inventory_type) END"
SHEET = lowered("_sheet_name")


def with_clean(tail: str) -> str:
    return f"WITH {CLEAN_SQL} {tail}"


def with_status(tail: str) -> str:
    return f"WITH {STATUS_SQL} {tail}"


def with_category(tail: str) -> str:
    return f"WITH {CATEGORY_SQL} {tail}"


def with_brand(tail: str) -> str:
    return f"WITH {BRAND_SQL} {tail}"


def with_family(tail: str) -> str:
    return f"WITH RECURSIVE {FAMILY_SQL} {tail}"


def audit_conditions() -> list[tuple[str, str, str, str]]:
    """Check, dimension, severity, condition over cat joined with dup (item_id counts)."""
    off = "(source_value <> 0 AND variant_mrp <> 0 AND qty <> 0 AND abs(source_value - variant_mrp * qty) > 10 AND abs(source_value - variant_mrp * qty) / greatest(source_value, 1) > 0.05)"
    item, upc = trim("item_id"), trim("upc")
    text = {
        "missing_item_id": f"{item} = ''", "missing_upc": f"{upc} = ''", "invalid_upc": rf"{upc} <> '' AND length(regexp_replace({upc}, '\D', '', 'g')) NOT IN (8, 12, 13, 14)", "duplicate_item_id": f"{item} <> '' AND n_same > 1",
        "uncategorized": "trim(normalized_category) IN ('', 'Other / Uncategorized', 'Uncategorized')", "unknown_brand": "trim(normalized_brand) IN ('', 'Unknown')", "low_conf_class": "subcategory_confidence = 'LOW'",
        "status_conflict": "is_status_conflict", "low_conf_status": "status_confidence = 'LOW'", "missing_weight": "total_weight = 0", "missing_volume": "total_volume_l = 0", "negative_weight": "total_weight < 0", "negative_volume": "total_volume_l < 0",
        "zero_quantity": "qty = 0", "negative_quantity": "qty < 0", "missing_mrp": "variant_mrp IS NULL", "zero_mrp": "variant_mrp = 0", "missing_value": "source_value IS NULL AND qty > 0", "zero_value": "source_value = 0 AND qty > 0",
        "negative_mrp": "variant_mrp < 0", "negative_value": "source_value < 0", "value_discrepancy": off,
    }
    return [(n, d, s, text[n]) for n, d, s, _ in _SPEC]


_SPEC = [
    *((n, "identity", s, "") for n, s in (("missing_item_id", "warning"), ("missing_upc", "info"), ("invalid_upc", "warning"), ("duplicate_item_id", "critical"))),
    *((n, "classification", s, "") for n, s in (("uncategorized", "warning"), ("unknown_brand", "warning"), ("low_conf_class", "info"))),
    *((n, "status", s, "") for n, s in (("status_conflict", "warning"), ("low_conf_status", "info"))),
    *((n, "measurement", s, "") for n, s in (("missing_weight", "info"), ("missing_volume", "info"), ("negative_weight", "critical"), ("negative_volume", "critical"), ("zero_quantity", "critical"), ("negative_quantity", "critical"))),
    *((n, "financial", s, "") for n, s in (("missing_mrp", "warning"), ("zero_mrp", "info"), ("missing_value", "warning"), ("zero_value", "info"), ("negative_mrp", "critical"), ("negative_value", "critical"), ("value_discrepancy", "warning"))),
]


def with_audit(tail: str) -> str:
    rows = ", ".join(f"CASE WHEN coalesce({c}, false) THEN '{n}' END" for n, _, _, c in audit_conditions())
    spec = ", ".join(f"('{n}', '{d}', '{s}')" for n, d, s, _ in audit_conditions())
    return with_category(f", au AS (SELECT *, count(*) OVER (PARTITION BY {trim('item_id')}) AS n_same FROM cat), fl AS (SELECT *, list_filter([{rows}], lambda x: x IS NOT NULL) AS failed FROM au), spec(\"check\", dim, severity) AS (VALUES {spec}) {tail}")


AMPLIFIERS, DIMENSIONS = audit.AMPLIFIERS, audit.DIMENSIONS
