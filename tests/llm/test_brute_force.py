"""Verdicts, placements, solutions and vectors against independent plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import common, decontaminate, graph, langid, mixing, quality, quotes, shard, simhash

SF = "/root/testdata/sf0.001"


def test_shards_have_the_smallest_capacity_over_true_groups(spark, monkeypatch):
    """Bins of 4 bits force several refinements; the largest shard must match a search over the groups themselves."""
    rng = random.Random(8)
    for bits, finer in ((2, 1), (4, 3), (16, 8)):
        monkeypatch.setattr(shard, "BIN_BITS", bits)
        monkeypatch.setattr(shard, "FINER_BITS", finer)
        texts = ["x" * rng.choice([0, 3, 40, 900, rng.randint(0, 3000)]) + str(rng.randrange(150)) for _ in range(400)]
        texts += ["hot group " * 20] * rng.choice([1, 150])
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        groups = Counter()
        for r in docs.select(F.xxhash64("text").alias("h"), F.length("text").alias("n")).collect():
            groups[r.h] += r.n + 8
        sizes = [groups[h] for h in sorted(groups)]
        got = shard.shard_documents(docs, 7).collect()
        load = Counter()
        for r in got:
            load[r.shard] += r.size
        assert max(load.values()) == shard.smallest_capacity(sizes, 7)
        where = {r.doc_id: r.shard for r in got}
        order = [where[r.doc_id] for r in docs.select("doc_id", F.xxhash64("text").alias("h")).orderBy("h").collect()]
        assert order == sorted(order)


def test_equal_rows_get_gapless_slots(spark):
    rows = [(None, None)] * 9000 + [(1, "a")] * 3 + [(i, "b") for i in range(50)]
    got = shard.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_tilt_against_bisection(spark):
    """Each source's multiplier solves one monotone equation; plain bisection finds it too."""
    rng = random.Random(1)
    cells = [(s, size, rng.randint(1, 30)) for s in range(4) for size in rng.sample(range(1, 900), 40)]
    total = {s: sum(n * size for t, size, n in cells if t == s) for s in range(4)}
    scale = {s: sum(n * size**2 for t, size, n in cells if t == s) / total[s] for s in range(4)}
    goal = {0: 2.2 * total[0], 1: 0.3 * total[1], 2: 1.0 * total[2], 3: 2.95 * total[3]}
    got = mixing.tilt(spark.createDataFrame(cells, "sid int, size long, n long"), goal, total, scale)
    for s in range(4):
        mass = lambda m: sum(n * size * min(3.0, math.exp(min(m * size / scale[s], 2))) for t, size, n in cells if t == s)  # noqa: B023, E731
        low, high = -60.0, 60.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (low, middle) if mass(middle) > goal[s] else (middle, high)
        assert mass(got[s]) == pytest.approx(goal[s], rel=1e-6) and got[s] == pytest.approx(low, rel=1e-4, abs=1e-4)


def test_many_rows_of_one_id_meet_the_target(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 7]), " ".join(["w"] * 5 + [str(i)]), "a") for i in range(300)] + [(i, "w w w w", "b") for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 6 for s in target)


def test_quality_scores_by_hand(spark):
    """Log ratios and scores recomputed from the hashes of words and word pairs of every document."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    words = docs.select("doc_id", common.words(F.col("text")).alias("w"))
    h = F.transform("w", lambda x: F.xxhash64(x))
    rows = {r.doc_id: r.h for r in words.select("doc_id", h.alias("h")).collect()}
    pairs = sorted({(a, b) for v in rows.values() for a, b in zip(v, v[1:])})
    joined = {(r.a, r.b): r.p for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("p")).collect()}
    grams = {i: [x % quality.BUCKETS for x in (*v, *(joined[p] for p in zip(v, v[1:])))] for i, v in rows.items()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    draw = {r.doc_id: r.d for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("held"), F.col("doc_id")), F.lit(1 << 30)).alias("d")).collect()}
    held = {i for i in good if draw.get(i, 0) < (1 << 30) // quality.HELD_OUT}
    every, trusted = Counter(b for g in grams.values() for b in g), Counter(b for i, g in grams.items() if i in good - held for b in g)
    n, m, k = sum(every.values()), sum(trusted.values()), quality.BUCKETS
    p = [(every[b] + 1) / (n + k) for b in range(k)]
    ratio = [math.log((trusted[b] + 4 * k * p[b]) / (m + 4 * k) / p[b]) for b in range(k)]
    raw = {i: sum(ratio[b] for b in g) / max(len(g), 1) for i, g in grams.items()}
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    cut = float(np.quantile([raw[i] for i in held if i in got and not got[i].base_failed], quality.QUANTILE))
    for i, r in got.items():
        assert r.score == pytest.approx(raw[i] - cut, abs=1e-4)
        if abs(r.score) > 1e-4:
            assert r.kept == (not r.base_failed and raw[i] >= cut)


def test_languages_by_hand(spark):
    """Vectors, nearest centroids and rejection from their definitions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(10**6, "中文字 日本", "en"), (10**6 + 1, "zzqx xqzz jjqx", None)], docs.schema))
    model = langid.fit(docs)
    idf, langs, centroids, low = model
    rows = docs.collect()
    known = [r for r in rows if r.lang and r.text and any(c.isalpha() for c in r.text)]

    def grams(text):
        data = b" " + b" ".join("".join(c.lower() if c.isascii() and c.isalpha() else c if ord(c) > 127 else " " for c in text).encode().split()) + b" "
        out = Counter()
        for i in range(len(data) - 1):
            out[(int.from_bytes(data[i : i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
        for i in range(len(data) - 2):
            out[(int.from_bytes(data[i : i + 3]) * 0x85EBCA77 & 0xFFFFFFFF) >> 20] += 1
        return out

    df = Counter(d for r in known for d in grams(r.text))
    assert idf == pytest.approx([math.log((1 + len(known)) / (1 + df[d])) + 1 for d in range(langid.DIMENSIONS)])
    assert set(langs) == {r.lang for r in known} and np.linalg.norm(centroids, axis=1) == pytest.approx(1, abs=1e-5)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in rows:
        v = np.zeros(langid.DIMENSIONS)
        for d, c in grams(r.text or "").items():
            v[d] = math.log1p(c) * idf[d]
        sims = centroids @ (v / (np.linalg.norm(v) or 1))
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und" and not got[r.doc_id].accepted
            continue
        best = int(np.argmax(sims))
        assert got[r.doc_id].score == pytest.approx(min(max(sims[best], 0), 1), abs=1e-5)
        if sims[best] - max((s for s, x in zip(sims, langs) if x != langs[best]), default=0) > 1e-5:
            assert got[r.doc_id].lang_pred == langs[best]
    assert not got[10**6 + 1].accepted


def test_large_shards_of_codes_are_dealt_again():
    rng = random.Random(9)
    fixed = rng.getrandbits(64)
    free = (1 << 40) - 1
    codes = [fixed & ~free | rng.getrandbits(40) for _ in range(400)]
    for c in codes[:100]:
        for b in rng.sample(range(40), 4):
            c ^= 1 << b
        codes.append(c)
    codes = list(dict.fromkeys(codes))
    root = {c: c for c in codes}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in simhash.link(codes, 4, free):
        assert (a ^ b).bit_count() <= 4
        root[find(a)] = find(b)
    got = {c: find(c) for c in codes}
    root = {c: c for c in codes}
    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    assert len({(got[c], find(c)) for c in codes}) == len(set(got.values())) == len({find(c) for c in codes}) < len(codes)


def test_reply_order(spark, monkeypatch):
    """Random trees over random turns, in blocks of three, against a plain walk."""
    monkeypatch.setattr(quotes, "BLOCK", 3)
    rng = random.Random(6)
    links, expected = [], {}
    for conv in range(4):
        turns = sorted(rng.sample(range(-20, 60), 25))
        up = {t: rng.choice(turns[:i]) for i, t in enumerate(turns) if i and rng.random() < 0.85}
        links += [(conv, t, u) for t, u in up.items()]
        def walk(t, at):
            expected[conv, t] = at  # noqa: B023
            n = 1
            for c in sorted(x for x, u in up.items() if u == t):  # noqa: B023
                n += walk(c, at + n)
            return n
        for t in turns:
            if t not in up and t in up.values():
                walk(t, 0)
    frame = spark.createDataFrame(links, "conv long, turn long, reply_to long")
    linked = {(c, t) for c, t, _ in links}
    roots = spark.createDataFrame(sorted({(c, u) for c, _, u in links} - linked), "conv long, turn long")
    size = Counter()
    parent = {(c, t): u for c, t, u in links}
    def top(c, t):
        while (c, t) in parent:
            t = parent[c, t]
        return t
    for c, t in expected:
        size[c, top(c, t)] += 1
    got = {(r.conv, r.turn): size[r.conv, top(r.conv, r.turn)] - r.ahead for r in quotes.reply_order(frame, roots).collect()}
    assert got == expected


def test_whole_messages_come_before_parts_of_others(spark):
    rows = [(1, 0, "u", "yes\nand more of it"), (1, 1, "u", "> yes\nwhy"), (1, 2, "u", "yes"), (1, 3, "u", "> yes\nok then"), (1, 4, "u", "> and more of it\nfine"), (1, 5, "u", "> ok then\nlast")]
    got = {r.turn: (r.reply_to, r.thread, r.place) for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0, 0), 1: (0, 0, 1), 2: (None, 2, 0), 3: (2, 2, 1), 4: (0, 0, 2), 5: (3, 2, 2)}


def test_filter_has_no_false_negatives(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BITS", 6)
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 6)
    bench = spark.createDataFrame([(i, f"some words of a set {i} that is quite long {i} to see") for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before some words of a set {i} that is quite long {i} to see after") for i in range(0, 300, 7)] + [(999, "nothing of it here at all")], "doc_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_hit) for r in decontaminate.decontamination_report(docs, bench).collect()}
    assert got == {i: (1, 13) for i in range(0, 300, 7)} | {999: (0, 0)}


def test_rounds_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    with common.scratch(spark) as made:
        roots = graph.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"))
        assert roots.count() == 10 and len(made) == 1 and len(list((tmp_path / "tables").iterdir())) == 1
    assert not list((tmp_path / "tables").iterdir())
