"""Quality rules learn from every labelled document, however many there are."""

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from lotwise.llm import quality


def test_cut_counts_every_held_out_document(spark):
    """The cut used to come from about 20,000 held-out documents: it was no quantile of the 25,000 that are here."""
    word = lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(997)).cast("string"))
    docs = spark.range(100_000).withColumnRenamed("id", "doc_id").select("doc_id", F.concat_ws(" ", *map(word, range(24))).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    draw = F.pmod(F.xxhash64(F.lit("held"), F.col("doc_id")), F.lit(1 << 30))
    out = quality.quality_rules(docs, labels)
    held = np.array([r.score for r in out.where(draw < (1 << 30) // quality.HELD_OUT).where("not base_failed").select("score").collect()])
    assert len(held) > 24_000
    assert np.quantile(held, quality.QUANTILE) == pytest.approx(0.0, abs=1e-12)


@pytest.mark.parametrize("values", [[], [2.5], [1.0, 2.0], [3.0] * 40, [0.0] * 30 + [1e-300, 1e9], [k * k / 7 for k in range(-500, 3000)]])
def test_quantile_is_exact(spark, values):
    got = quality.quantile(spark.createDataFrame([(float(v),) for v in values], "x double"), quality.QUANTILE)
    assert got == (pytest.approx(np.quantile(values, quality.QUANTILE), rel=1e-12) if values else None)


def test_every_trusted_document_counts(spark):
    """About 400,000 of them were chosen by a hash of the id."""
    labels = spark.range(500_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    assert quality.trusted_ids(labels).count() == 500_000


@pytest.mark.parametrize("kind", ["long", "int", "string"])
@pytest.mark.parametrize("shuffled", [False, True])
def test_marks_are_exact(spark, kind, shuffled, monkeypatch):
    """Ids that share a row of bits, negative and far ones, null; the shuffle join gives the same."""
    if shuffled:
        monkeypatch.setattr(quality, "sized", lambda df: df.hint("merge"))
    far = 1 << (62 if kind == "long" else 30)
    asked = {*range(-70, 70, 3), 4096, far, -far, -2 * far}
    rows = [*range(-200, 200), 4095, 4096, 4096, 4097, far, far + 1, -far, -far - 1, -2 * far, 2 * far - 1, None]
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long").select(F.col("id").cast(kind).alias("id"))
    got = quality.marked(frame(rows), frame(sorted(asked)), "id", "mark").collect()
    assert sorted(map(str, got)) == sorted(map(str, [Row(id=str(i) if kind == "string" and i is not None else i, mark=i in asked) for i in rows]))
