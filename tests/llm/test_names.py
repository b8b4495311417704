"""Every stage keeps extra columns as they are, whatever their names; BK-trees prune; long messages cost in proportion."""

import random
import time

import pytest

import corpus_pipeline
from lotwise.llm import decontaminate, quotes, simhash

SF = "/root/testdata/sf0.001"
NAMES = """__id __key __source __c_source __size __c_size __pick __base __cutoff __copy __node __n __h __least __out __gone __bytes __cut __good __j
id id_ own own_ key text_key cut root node bytes hash least own_node source_ size pick c_source c_size base cutoff copy kept score fp band label item n w""".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    rows += rows[:6] + [(rows[0][0], "another text under an old id", "en", "b", 1), (None, rows[1][1], "en", "a", 1), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, tag int, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, i, *(f"{n}{rng.randrange(9)}" for n in NAMES)) for i, r in enumerate(rows)], schema).repartition(3)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_extra_columns(spark, docs, name, stage):
    after = stage(spark, docs, SF)
    assert after.columns == docs.columns
    given = {r.tag: r for r in docs.collect()}
    kept = after.collect()
    assert kept and all(r == given[r.tag] for r in kept)
    plain = stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), SF)
    assert sorted(str(tuple(r)[:5]) for r in kept) == sorted(str(tuple(r)) for r in plain.collect())


def test_others_keep_extra_columns(spark, docs):
    given = {r.tag: r for r in docs.collect()}
    assert all(r == given[r.tag] for r in simhash.keep_one(docs).collect())
    cut = decontaminate.remove_spans(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert cut.columns == docs.columns and all(tuple(r)[2:] == tuple(given[r.tag])[2:] for r in cut.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(given)


def test_trees_prune():
    """Distances computed in one tree of random codes and in one of a large family, against all pairs."""
    counted = 0

    class Code(int):
        def __xor__(self, other):
            nonlocal counted
            counted += 1
            return int(self) ^ int(other)

    rng = random.Random(5)
    apart = [Code(rng.getrandbits(64)) for _ in range(2000)]
    simhash._tree_edges(apart, 4)
    assert counted < 0.45 * 2000 * 1999 / 2
    counted, middle = 0, rng.getrandbits(64)
    family = list({Code(middle ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)) for _ in range(1500)})
    assert len(simhash._tree_edges(family, 4)) == len(family) - 1
    assert counted < 0.1 * len(family) ** 2 / 2


def test_many_quoted_lines(spark):
    def seconds(n):
        said = "\n".join(f"line {i} of a very long message" for i in range(n))
        quoted = "\n".join(f"> line {i} of a very long message" for i in range(n))
        rows = [(1, 0, "user", said), (1, 1, "assistant", f"{quoted}\nyes"), (1, 2, "user", "> yes\nok"), (1, 3, "assistant", "> ok\nbye")]
        began = time.time()
        got = {r.turn: r.reply_to for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
        assert got == {0: None, 1: 0, 2: 1, 3: 2}  # short passages link too
        return time.time() - began
    seconds(100)
    few, many = seconds(10_000), seconds(40_000)
    assert many < 6 * few + 5
