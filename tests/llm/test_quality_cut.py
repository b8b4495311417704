"""The cut of the quality score follows the data: the same shares at two sizes."""

import pytest
from pyspark.sql import functions as F

from lotwise.llm import quality


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_shares_hold_at_every_size(spark, sf):
    """A fixed cut of -0.15 kept 8 % of the bad documents at sf0.01 and 27 % at sf0.1."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_rules(docs, labels).where("not base_failed").join(labels, "doc_id")
    counted = got.groupBy("quality", "toxic").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()
    shares = {(r.quality, r.toxic): (r.kept, r.n) for r in counted}
    print(sf, shares)
    kept, n = shares[1, 0]
    assert kept >= 0.93 * n
    kept, n = shares[0, 0]
    assert kept <= 0.10 * n
