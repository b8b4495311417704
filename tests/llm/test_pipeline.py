"""The corpus pipeline: stages, and what each of them promises, on the smallest tables."""

from collections import Counter

import corpus_pipeline
from lotwise.llm import decontaminate, mixing, quality, shard
from tests.llm.test_shingles import groups

SF = "/root/testdata/sf0.001"


def near_copies_left_out(docs):
    """Brute force over all pairs: of each group linked at a five-word similarity of 0.8 the smallest id."""
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    root, _ = groups([t for _, t in rows])
    least = {}
    for (i, _), g in zip(rows, root):
        least[g] = min(least.get(g, i), i)
    return Counter(least.values())


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    expected = [
        lambda d: Counter(r.doc_id for r in quality.quality_rules(d, labels).collect() if r.kept),
        near_copies_left_out,
        lambda d: Counter(r.doc_id for r in decontaminate.decontamination_report(d, bench).collect() if not r.contaminated),
        lambda d: Counter({r.doc_id: r.copies for r in mixing.mix(d).collect() if r.copies}),
    ]
    for (_, stage), want in zip(corpus_pipeline.STAGES, expected):
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        assert ids(after) == want(docs)
        docs = spark.createDataFrame(after.collect(), after.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids(last) == ids(docs)
    whole = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, shard.shard_documents(docs).collect()))
