"""Wide rows go to Python in batches of few bytes."""

import pyarrow as pa
from pyspark.sql import functions as F

from lotwise.llm import shingles
from lotwise.llm.common import small_batches

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_in_bytes(spark):
    """10,000 rows of 4 kB are one batch of 40 MB by default."""
    def largest(batches):
        yield pa.RecordBatch.from_pydict({"bytes": [max(b.nbytes for b in batches)]})

    was = spark.conf.get(SETTING, None)
    wide = spark.range(0, 10_000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    with small_batches(spark):
        assert wide.mapInArrow(largest, "bytes long").first()[0] < 5 << 20
    assert spark.conf.get(SETTING, None) == was


def test_near_dedup_asks_for_small_batches(spark, monkeypatch):
    """An executor was stopped at 3,001 MB of its 3,000 after this stage."""
    seen, make = [], shingles.shingle_sets
    monkeypatch.setattr(shingles, "shingle_sets", lambda docs, *names: seen.append(docs.sparkSession.conf.get(SETTING)) or make(docs, *names))
    was = spark.conf.get(SETTING, None)
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "h")], "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.drop_near_copies(docs).collect()) == [1, 3]
    assert seen == ["2m"] and spark.conf.get(SETTING, None) == was
