"""Conversation repair against a recursion over whole edit strings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import product

import pytest

from lotwise.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, conv string, block int, at int, fault string, edits string, own string"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def best_edits(symbols):
    """From the end: the cheapest rest and its least string; what is put before it changes no order."""
    @lru_cache(None)
    def best(i, last, inserts):
        found = [(0, "")] if i == len(symbols) and last in ("", "a") else []
        def go(cost, edit, rest):
            if rest:
                found.append((cost + rest[0], edit + rest[1]))
        if inserts < 3:
            for role in "ua":
                if role in NEXT[last]:
                    go(2, "I", best(i, role, inserts + 1))
        if i < len(symbols):
            go(3, "D", best(i + 1, last, 0))
            if symbols[i] != "x":
                extra, initial = symbols[i].isupper(), symbols[i].lower()
                if initial in NEXT[last]:
                    go(extra, "K", best(i + 1, initial, 0))
                for role in "ua":
                    if role in NEXT[last]:
                        go(2 + extra, "R", best(i + 1, role, 0))
        return min(found, default=None)
    for i in range(len(symbols), -1, -50):  # in steps, so that the recursion stays shallow
        for last in NEXT:
            best(i, last, 0)
    return best(0, "", 0)


def brute_force(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in own if t is not None}
        seen, symbols, faults = set(), "", []
        for _, role, text in own:
            word = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not word else "duplicate" if (role, text) in seen else "truncated" if word[-1] not in ".!?" else ""
            seen.add((role, text))
            known = role[:1] if role[:1] in tuple("sua") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else known.upper() if fault else known
            faults.append(fault)
        cost, audit = best_edits(symbols)
        last, repaired, at = "", [], 0
        for e in audit:
            if e in "IR":
                last = "a" if last == "u" else "u"
                repaired.append(({"u": "user", "a": "assistant"}[last], own[at][2] if e == "R" else ""))
            elif e == "K":
                repaired.append(own[at][1:])
                last = own[at][1][:1]
            at += e != "I"
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        yield conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()


def test_cheapest_edits():
    for n in range(5):
        for s in product("suaoUAx", repeat=n):
            found = conversations.cheapest("".join(s), 0)
            assert min(found[e] for e in (0, 3) if found[e]) == best_edits("".join(s))
    rng = random.Random(6)
    for _ in range(300):
        s = "".join(rng.choices("suaoSUAOx", [1, 4, 4, 1, 1, 2, 2, 1, 1], k=rng.randrange(60)))
        found = conversations.cheapest(s, 0)
        assert min(found[e] for e in (0, 3) if found[e]) == best_edits(s)


def test_strings_are_compared_at_their_common_prefix(monkeypatch):
    for prime in (conversations._PRIME, 7):  # with 7, hashes collide all the time
        monkeypatch.setattr(conversations, "_PRIME", prime)
        rng, audits = random.Random(8), conversations.Audits()
        nodes = [0] + [audits.add(rng.randrange(max(1, i // 2), i + 1) if i else 0, rng.choice("DIKR")) for i in range(400)]
        assert all(audits.less(a, b) == (audits.text(a) < audits.text(b)) for a in nodes[::3] for b in nodes[::5])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    say = lambda: rng.choice(["Hello.", "hello", "Why?", " \t", "", "Yes!", "no.  ", "wait", f"{rng.random()}.", f"{rng.random()}", None])
    out = [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), say()) for c in range(150) for t in range(rng.randrange(1, 12)) if rng.random() < 0.9]
    out += [(500, t, ("user", "assistant")[t % 2], f"Turn {t // 3}{'.' * (t % 5 > 0)}") for t in range(900)] + [(501, None, "user", None)] * 3 + [(None, t, "user", "Who am I?") for t in range(3)]
    out += [(502, 1, "user", "a long text. " * 200_000), (502, 2, "assistant", "yes." * 3), (503, 2**60, "user", "far."), (503, -5, "system", "near.")]
    return out + [(c, 0, "user", "x.") for c in range(600, 700)]


def test_repair(spark, rows, monkeypatch):
    extra = ("c", 1, 2, "f", "e", "o")
    table = spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(5)
    expected = sorted(brute_force(rows), key=str)
    got = conversations.damaged_and_repaired(table)
    assert sorted(map(tuple, got.collect()), key=str) == expected
    monkeypatch.setattr(conversations, "PIECE", 4)  # most conversations get several pieces
    assert sorted(map(tuple, conversations.damaged_and_repaired(table).collect()), key=str) == expected
    monkeypatch.setattr(conversations, "PIECE_CHARS", 10)  # and are read again
    assert sorted(map(tuple, conversations.damaged_and_repaired(table).collect()), key=str) == expected
    assert conversations.damaged_and_repaired(table.where("false")).count() == 0
