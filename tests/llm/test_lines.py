"""Line dedup against a brute-force version."""

import hashlib
import random
from collections import Counter, defaultdict

from lotwise.llm import line_dedup

SCHEMA = "doc_id long, text string, id string, t1 int, keep int, first string, pos string, h1 string, n_lines string"


def brute_force(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(-1 if i is None else i)
    gone = lambda i, x: len(holders[key(x)]) >= 3 and (-1 if i is None else i) < max(holders[key(x)])
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not gone(i, x)]
        yield i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_lines(spark):
    rng = random.Random(1)
    common = [f"A line that many documents hold, number {i} É" for i in range(12)] + ["short line", "exactly twenty chars", "exactly 19 chars....", "e" * 19, "é" * 20]
    shapes = [str, str.upper, lambda x: f" \t{x}\r", lambda x: f"\x0b{x}\f", lambda x: f"\xa0{x}", lambda x: x.replace("É", "é")]
    rows = [(i, "\n".join(rng.choice(shapes)(rng.choice(common)) if rng.random() < 0.6 else f"own line {rng.random()} of one document" for _ in range(rng.randrange(9)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "\n".join(common[:3] * 400)), (204, "\n".join(f"own {i} of a very long document" for i in range(30_000)) + "\n" + common[0])]
    rows += [rows[3], rows[4], (5, common[1] + "\n" + common[2]), (None, common[0] + "\nrest"), (None, common[0]), (None, None)]
    rows += [(300, "only two documents hold this"), (301, "only two documents hold this"), (302, "thrice in one document\n" * 3)]
    extra = ("x", 1, 2, "f", "p", "h", "n")
    docs = spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(5)
    got = Counter(map(tuple, line_dedup.line_report(docs).collect()))
    assert got == Counter(brute_force(rows)) and sum(n for (_, _, n, _) in got) > 100
    assert line_dedup.line_report(docs.where("false")).count() == 0
    bitmaps = line_dedup.keep_bitmaps(docs)
    assert "text" not in bitmaps.columns and all(a.first <= a.last < b.first for r in bitmaps.collect() for a, b in zip(r.keep, r.keep[1:]))


def test_a_hot_line_spreads_over_tasks(spark):
    """Half of all lines are one and the same: their hashes are ranged with the document, so no task holds them all."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('the very same line everywhere\nanother line of document ', id) AS text")
    got = line_dedup.line_report(docs).groupBy("n_dropped").count().collect()
    assert {(r.n_dropped, r["count"]) for r in got} == {(1, 3999), (0, 1)}
    held = docs.selectExpr("doc_id", "xxhash64('x') AS h").repartitionByRange(4, "h", "doc_id")
    assert len({r.p for r in held.selectExpr("spark_partition_id() AS p").distinct().collect()}) > 1
