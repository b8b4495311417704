"""Subcategories by keywords, against every keyword tried on every text."""

import random

from lotwise.functions import vocabulary as V
from lotwise.operators import category


def test_keywords(spark, monkeypatch):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abc ") for _ in range(n)).strip() or "a"
    taxonomy = [(c, f"{c}{i}", tuple(rng.choice([letters(rng.randint(1, 5)), rf"\b{rng.choice('abc') * rng.randint(1, 3)}\b"]) for _ in range(rng.randint(0, 6)))) for c in "XYZ" for i in range(4)]
    texts = list({(letters(rng.randint(1, 25)), rng.choice("XYZW")) for _ in range(300)} | {("", "X"), ("é" * 40 + "abc", "Y")})
    def score(text, words):
        own = "".join(x if x.isascii() and x.isalnum() else " " for x in text).split()
        return sum(len(k[2:-2]) * (k[2:-2] in own) if k.startswith("\\b") else len(k) * (k in text) for k in words)
    expected = {}
    for t, c in texts:
        own = [(score(t, k), -i, s) for i, (x, s, k) in enumerate(taxonomy) if x == c]
        if own:
            expected[t, c] = max(own)[2]
    frame = spark.createDataFrame(texts, "text string, category string")
    for most in (category.BROADCAST_KEYWORDS, 0):
        monkeypatch.setattr(category, "BROADCAST_KEYWORDS", most)
        assert {(r.text, r.category): r.keyword for r in category.best_subcategories(frame, taxonomy).collect()} == expected


def test_a_large_taxonomy_costs_no_larger_plan(spark):
    """Thirty thousand keywords: a join of the same shape, where an expression would hold them all."""
    many = [*V.TAXONOMY, *(("Grocery", f"Kind {i}", tuple(f"keyword {i} {j}" for j in range(100))) for i in range(300))]
    rows = spark.createDataFrame([("", "Rice keyword 217 55 pack", "X"), ("", "Basmati Rice", "X")], "source_category string, normalized_product_name string, normalized_brand string")
    got = category.categorize(rows.withColumn("source_category", rows.source_category), domains=[], foods=[], taxonomy=many, raw_map={"": ("Grocery", None)})
    assert "Kind 217" in {r.subcategory for r in got.collect()}
    table = category.keyword_table(spark, many)
    assert table.count() == sum(len(k) for _, _, k in many) and len(category.best_subcategories(rows.selectExpr("lower(normalized_product_name) text", "'Grocery' category"), many)._jdf.queryExecution().optimizedPlan().toString()) < 60_000
