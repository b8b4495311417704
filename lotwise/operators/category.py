"""Category and subcategory by ordered rules."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lotwise.functions import text as X, vocabulary as V
from lotwise.sources.tables import once_for_all, once_for_each, shared_table, sized

OTHER = "Other / Uncategorized"
BASE = "Grocery"
#: The columns that categorize reads and adds.
READ = ["source_category", "normalized_product_name", "normalized_brand"]
ADDED = {"normalized_category", "subcategory", "subcategory_confidence", "classification_rule", "is_ambiguous"}
#: A taxonomy of up to so many keywords is broadcast; a larger one is joined by a shuffle.
BROADCAST_KEYWORDS = 200_000


def pattern(words: V.Words) -> str:
    """A pattern for any of the words, whole, that Java and RE2 read alike."""
    plain = lambda w: re.escape(w).replace(r"\ ", " ").replace(r"\-", "-").replace(r"\&", "&")
    return r"\b(?:" + "|".join(".*".join(map(plain, w.split(" ... "))) for w in words) + r")\b"


def has(text: Column, words: V.Words) -> Column:
    return text.rlike(pattern(words)) if words else F.lit(False)


class Hits:
    """Which patterns a text column has: called with words, whether it has any of them. All words that were asked about
    are looked for once for each distinct text."""

    def __init__(self, column: str, text: Column):
        self.column, self.text, self.added, self.patterns = column, text, f"__hits_{column}", {}

    def __call__(self, words: V.Words) -> Column:
        return F.col(self.added)[self.patterns.setdefault(pattern(words), len(self.patterns))] if words else F.lit(False)

    def judge(self) -> tuple[list[str], Callable[[DataFrame], DataFrame]]:
        found = F.array(*map(self.text.rlike, self.patterns)) if self.patterns else F.array(F.lit(False))
        return [self.column], lambda r: r.withColumn(self.added, found)


def ways(match: V.Match, name: Hits, brand: Hits) -> Column:
    """Whether a name or brand has what a match asks for, leaving ``without`` and source categories aside."""
    out = name(match.words)
    if match.brands:
        out = out | brand(match.brands)
    for also in match.also:
        one = name(also.words)
        if also.together:
            one = one & name(also.together)
        if also.without:
            one = one & ~name(also.without)
        out = out | one
    return out


def scrubbed(category: Column | str, none: Sequence[str] = V.NO_CATEGORIES) -> Column:
    """A source category in lower case; empty if it only names a stock state, a sheet or a lot."""
    raw = F.lower(X.trimmed(category))
    plain = X.single_spaced(F.regexp_replace(raw, r"[()_\-\[\]]", " "))
    words = F.split(plain, " ")
    empty = raw.isin(*none) | plain.isin(*none) | raw.rlike(r"^(sheet\s*\d+|lot[\s-]*\d+)$") | F.forall(words, lambda w: w.isin(*none) | w.rlike(r"^\d+$"))
    return F.when(empty, F.lit("")).otherwise(raw)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Keywords meet texts on one gram of at most so many letters each.
GRAM = 3


def keyword_table(spark: SparkSession, taxonomy: Sequence[tuple[str, str, V.Words]]) -> DataFrame:
    r"""The keywords of a taxonomy as rows: category, at (place of the subcategory in the category), sub, word, whole (given as
    \b...\b), gram (the rarest of its grams among all keywords)."""
    rows, place, seen = [], Counter(), Counter()
    grams = lambda w: [w[i : i + GRAM] for i in range(max(len(w) - GRAM, 0) + 1)]
    plain = lambda k: k[2:-2] if k.startswith("\\b") else k
    for _, _, words in taxonomy:
        seen.update(g for k in words for g in grams(plain(k)))
    for category, sub, words in taxonomy:
        for k in words:
            rows.append((category, place[category], sub, plain(k), k.startswith("\\b"), min(grams(plain(k)), key=lambda g: (seen[g], g))))
        place[category] += 1
    return spark.createDataFrame(rows, "category string, at int, sub string, word string, whole boolean, gram string")


def best_subcategories(texts: DataFrame, taxonomy: Sequence[tuple[str, str, V.Words]]) -> DataFrame:
    """Distinct (text, category) with the category's best-scoring subcategory: columns text, category, keyword.

    A subcategory scores the summed length of its keywords in the text, those given as whole words among its words, others
    anywhere. The first wins on ties and without a hit; a category that the taxonomy lacks has none. Texts are not compared
    with every keyword: their grams are joined with the one gram that each keyword is filed under, and what meets is
    verified, so the cost of a text follows its length and hits, not the number of keywords.
    """
    spark = texts.sparkSession
    words = keyword_table(spark, taxonomy)
    n = sum(len(k) for _, _, k in taxonomy)
    words = F.broadcast(words) if n <= BROADCAST_KEYWORDS else words
    lengths = sorted({min(len(k[2:-2] if k.startswith("\\b") else k), GRAM) for _, _, ks in taxonomy for k in ks})
    cut = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - size + 1, F.lit(1))), lambda i: F.substring("text", i, size))
    pieces = F.array_distinct(F.concat(F.array().cast("array<string>"), *map(cut, lengths)))
    met = texts.select("text", "category", F.explode(pieces).alias("gram")).join(words, ["category", "gram"])
    holds = F.when(F.col("whole"), F.array_contains(F.split("text", r"[^a-z0-9]+"), F.col("word"))).otherwise(F.col("text").contains(F.col("word")))
    scores = met.where(holds).groupBy("text", "category", "at", "sub").agg(F.sum(F.length("word")).alias("score"))
    best = scores.groupBy("text", "category").agg(F.max_by("sub", F.struct("score", -F.col("at"))).alias("best"))
    first = spark.createDataFrame(list({c: s for c, s, _ in reversed(list(taxonomy))}.items()), "category string, first string")
    return texts.join(best, ["text", "category"], "left").join(F.broadcast(first), "category").select("text", "category", F.coalesce("best", "first").alias("keyword"))


def _looked_up(column: str, pairs: dict[str, str]) -> Column:
    """What a short constant table holds for a column's value; null if nothing."""
    return F.expr(f"CASE {column} {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(v)}' for k, v in pairs.items())} END") if pairs else F.lit(None).cast("string")


def categorize(records: DataFrame, domains: Sequence[V.Rule] = tuple(V.DOMAIN_RULES), foods: Sequence[V.Food] = tuple(V.FOOD_RULES), taxonomy: Sequence[tuple[str, str, V.Words]] = tuple(V.TAXONOMY), raw_map: dict[str, tuple[str, str]] | None = None, ambiguous: V.Words = V.AMBIGUOUS, unlocked: V.Words = V.UNLOCKED) -> DataFrame:
    """Adds normalized_category, subcategory, subcategory_confidence, classification_rule and is_ambiguous.

    An explicit category that is not ``unlocked`` is kept. Else the first domain rule whose words and gate fit decides, else the
    first food identity that no other rules out, else the mapped or given source category with its best subcategory
    by keywords, else other. Rules read name, brand and source category only, and are asked once for each combination.
    """
    return once_for_each(records, READ, lambda r: _by_rules(r, domains, foods, taxonomy, V.RAW_CATEGORIES if raw_map is None else dict(raw_map), ambiguous, unlocked))


def _by_rules(records: DataFrame, domains: Sequence[V.Rule], foods: Sequence[V.Food], taxonomy: Sequence[tuple[str, str, V.Words]], raw_map: dict[str, tuple[str, str]], ambiguous: V.Words, unlocked: V.Words) -> DataFrame:
    name, brand = Hits("normalized_product_name", F.lower(X.trimmed("normalized_product_name"))), Hits("normalized_brand", F.lower(X.trimmed("normalized_brand")))
    known = list(dict.fromkeys(c for c, _, _ in taxonomy))
    r = records.withColumns({"__raw": scrubbed("source_category"), "__both": F.lower(F.trim(F.concat_ws(" ", "normalized_product_name", "normalized_brand")))})
    raw = F.col("__raw")
    r = r.withColumns(
        {
            "__mapped_cat": _looked_up("__raw", {k: c for k, (c, _) in raw_map.items()}),
            "__mapped_sub": _looked_up("__raw", {k: c for k, (_, c) in raw_map.items() if c}),
            "__given": _looked_up("__raw", {c.lower(): c for c in known if c.lower() not in raw_map}),
        }
    )
    r = r.withColumn("__locked", F.when(~F.col("__given").isin(*unlocked), F.col("__given")))

    domain = F.lit(None).cast("struct<rule:string,cat:string,sub:string>")
    for rule in reversed(domains):
        fits = ways(rule.match, name, brand)
        if rule.match.sources:
            fits = fits | raw.isin(*rule.match.sources)
        fits = fits & ~name(rule.match.without)
        if rule.gate is not None:
            fits = fits & raw.isin(*rule.gate)
        sub = F.lit(rule.otherwise)
        for s, words in reversed(rule.subcategories):
            sub = F.when(name(words), F.lit(s)).otherwise(sub)
        domain = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.category).alias("cat"), sub.alias("sub"))).otherwise(domain)

    # food identities depend on earlier ones: one projection for each that is needed
    flags: dict[str, str] = {}
    identities: dict[str, Column] = {}
    for i, food in enumerate(foods):
        fits = ways(food.match, name, brand)
        if food.match.sources:
            given = raw.isin(*food.match.sources)
            for other in food.sources_not_if:
                given = given & ~F.col(flags[other])
            fits = fits | given
        fits = fits & ~name(food.match.without)
        for other in food.not_if:
            fits = fits & ~F.col(flags[other])
        flags[food.subcategory] = f"__f{i}"
        identities[f"__f{i}"] = fits
    unsure = name(ambiguous)
    r = once_for_all(r, [name.judge(), brand.judge()]).withColumns({"__domain": domain, "__ambiguous": unsure})
    for flag, fits in identities.items():
        r = r.withColumn(flag, fits)
    r = r.drop(name.added, brand.added)
    food_sub = F.coalesce(*(F.when(F.col(flags[f.subcategory]), F.lit(f.subcategory)) for f in foods)) if foods else F.lit(None).cast("string")
    r = r.withColumn("__food", food_sub)

    main = F.coalesce(F.when(F.col("__food").isNotNull(), F.lit(BASE)), F.col("__mapped_cat"), F.col("__given"), F.when(raw != "", X.title_at_boundaries("source_category")), F.lit(OTHER))
    r = r.withColumn("__main", F.coalesce("__locked", "__domain.cat", main))
    if taxonomy:
        r = shared_table(r)  # rules once: texts go one way, what they come from another
        found = best_subcategories(r.select(F.col("__both").alias("text"), F.col("__main").alias("category")).where("category is not null").distinct(), taxonomy)
        found = sized(shared_table(found.select(F.col("text").alias("__text"), F.col("category").alias("__cat"), F.col("keyword").alias("__keyword"))))
        r = r.join(found, (F.col("__both") == F.col("__text")) & (F.col("__main") == F.col("__cat")), "left")
    keyword = F.coalesce(F.col("__keyword") if taxonomy else F.lit(None).cast("string"), F.lit("General"))
    sub = F.when(F.col("__locked").isNotNull(), keyword).otherwise(F.coalesce("__domain.sub", "__food", "__mapped_sub", keyword))
    r = r.withColumn("__sub", sub)
    sure = F.col("__locked").isNotNull() | F.col("__domain").isNotNull()
    general = F.col("__sub").isin("General", "General Staples")
    return r.withColumns(
        {
            "normalized_category": F.col("__main"),
            "subcategory": F.col("__sub"),
            "subcategory_confidence": F.when(sure, "HIGH").when(F.col("__main") == OTHER, "LOW").when(general, "MEDIUM").otherwise("HIGH"),
            "classification_rule": F.when(F.col("__locked").isNotNull(), F.lit("explicit_domain_lock")).when(F.col("__domain").isNotNull(), F.col("__domain.rule")).when(F.col("__main") == OTHER, F.lit("default_fallback")).when(general, F.lit("category_general_fallback")).otherwise(F.lit("identity_priority_match")),
            "is_ambiguous": F.col("__ambiguous"),
        }
    ).drop(*(c for c in r.columns if c.startswith("__")))
