"""Near copies by five-word shingles against brute force over all pairs."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from lotwise.llm import shingles, simhash


def lower(t):
    return (t or "").encode().lower().split()


def sets(t):
    w = lower(t)
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def similar(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def groups(texts):
    """Components of similar texts, and the similar pairs."""
    root, every, pairs = list(range(len(texts))), [sets(t) for t in texts], []
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(texts)):
        for b in range(a):
            if similar(every[a], every[b]):
                pairs.append((a, b))
                root[find(a)] = find(b)
    return [find(i) for i in range(len(texts))], pairs


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.random()}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [None, "", " \n", "one", "One", "two words"]
    for _ in range(60):
        base = say(rng.randint(60, 200))
        texts += [base, edited(rng, base, 1), edited(rng, base, 2), edited(rng, base, 5)]
    passage = say(60)
    texts += [f"{say(40)} {passage}" for _ in range(40)]  # alike, but far from 0.8
    copy = say(120)
    for _ in range(40):  # a chain of near copies whose ends are not alike
        copy = edited(rng, copy, 1)
        texts.append(copy)
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies_are_all_found(spark, rows):
    """With SimHash at 4 words and 4 bits most of these pairs were missed."""
    out = shingles.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    root, pairs = groups([t for _, t in rows])
    kept = {min(i for i, r in enumerate(root) if r == g) for g in set(root)}
    assert Counter(r.doc_id for r in out.collect()) == Counter(kept)
    found = sum((simhash.fingerprint((rows[a][1] or "").encode(), 4) ^ simhash.fingerprint((rows[b][1] or "").encode(), 4)).bit_count() <= 4 for a, b in pairs)
    assert found < len(pairs) / 2


def test_rows_that_share_an_id(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"x{rng.randint(0, 9999)}" for _ in range(n))
    a, clean, other = say(80), say(80), say(80)
    rows = [(1, a), (2, edited(rng, a, 1)), (2, clean), (2, clean), (3, other), (None, a), (None, a)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert Counter(map(tuple, out.collect())) == Counter([(1, a), (2, clean), (3, other), (None, a), (None, a)])


def test_empty(spark):
    assert shingles.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
