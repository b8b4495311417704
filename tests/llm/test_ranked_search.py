"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from lotwise.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
EXTRA = "n int, terms string, tfs string, item string, id string, score int, rank int"


def terms(t):
    return TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_force(docs, items, k):
    known = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, all_terms = len(known), sum(sum(c.values()) for _, c in known)
    df = Counter(t for _, c in known for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    for item, own in asked.items():
        scored = []
        for i, c in known:
            m = 50 + 50 * sum(c.values()) * n_docs // all_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1):
            yield item, rank, i, -s


def test_search(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "the Of stone river Éclair grün niño light 12 x".split() for b in ("", "s", "ing", "3")]
    say = lambda n: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, say(rng.randint(1, 60))) for i in range(900)]
    docs += [(1000 + i, docs[7][1]) for i in range(120)] + [(2000, None), (2001, ""), (2002, "-- ... \x7f"), (None, docs[7][1]), (None, say(9)), docs[3], docs[3], (2003, say(30_000)), (2004, "the,of;STONE")]
    items = [(i, say(rng.randint(1, 30))) for i in range(12)] + [(1, say(3)), (50, None), (51, "--"), (52, "unheard words"), (53, "ÉCLAIR Éclair éclair"), (None, docs[7][1])]
    extra = (1, "t", "f", "i", "d", 2, 3)
    frame = lambda rows, key: spark.createDataFrame([(*r, *extra) for r in rows], f"{key} long, text string, {EXTRA}").repartition(3)
    d, q = frame(docs, "doc_id"), frame(items, "item_id")
    for k in (1, 50):
        got = ranked_search.search(d, q, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, got.collect())) == Counter(brute_force(docs, items, k))
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 60)  # several blocks of items
    assert Counter(map(tuple, ranked_search.search(d, q, 5).collect())) == Counter(brute_force(docs, items, 5))
    assert ranked_search.search(d.where("false"), q).count() == 0 and ranked_search.search(d, q.where("false")).count() == 0


def test_bounds_leave_branches_out():
    rng = np.random.default_rng(3)
    n, n_terms = 4000, 60
    topics = [rng.random(n_terms) < 0.3 for _ in range(40)]  # documents of a topic use its terms
    sets = [np.flatnonzero(topics[d % 40] & (rng.random(n_terms) < 0.8)) for d in range(n)]
    start = np.r_[0, np.cumsum([len(s) for s in sets])]
    term = np.concatenate(sets).astype(np.int64)
    tf = rng.integers(1, 4, len(term))
    m = rng.integers(51, 200, n)
    trie = ranked_search.Trie(list(range(n)), m, start, term, tf, n_terms)
    assert all(hi - lo <= ranked_search.LEAF or a < b for (lo, hi), (a, b) in zip(trie.span, trie.below))
    dense = np.zeros(n_terms, np.int64)
    wanted = np.array([20, 31, 44, 58])
    dense[wanted] = [3000, 4000, 5000, 6000]
    best = []
    looked = trie.search(wanted, dense[wanted], dense, best, 10)
    score = np.zeros(n, np.int64)
    row = np.repeat(np.arange(n), np.diff(start))
    np.add.at(score, row, dense[term] * ranked_search.contribution(tf, m[row]))
    assert sorted((-s, d.id) for s, d in best) == sorted((-int(s), d) for d, s in enumerate(score))[:10]
    assert looked < n / 2
