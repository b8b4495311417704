"""Merges in chains, products by an identity profile, and progressions on a stream, against plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone
from itertools import product

import pytest
from pyspark.sql import functions as F

from lotwise.operators import brands, products
from lotwise.streaming import events as ev


def test_merges(spark):
    rng = random.Random(3)
    names = [f"b{i}" for i in range(40)]
    master = spark.createDataFrame([(n, n.upper(), [n, f"{n} x"], i + 1, 1.0 * i, 2.0 * i, 0.5 * i) for i, n in enumerate(names)], "brand_fingerprint string, canonical_brand_name string, raw_brand_names array<string>, record_count long, total_qty double, total_value double, total_weight double")
    up = {n: rng.choice(names[:i]) for i, n in enumerate(names) if i and rng.random() < 0.8}
    merges = [*up.items(), ("b39", "gone"), ("gone", "b1"), ("b5", "b5"), next(iter(up.items()))]
    up = {a: b for a, b in up.items()}
    def end(n):
        while n in up:
            n = up[n]
        return n
    frame = lambda m: spark.createDataFrame(m, "retired string, kept string")
    got = {r.brand_fingerprint: r for r in brands.aliases(brands.merge_brands(master, frame(merges))).collect()}
    assert set(got) == {end(n) for n in names} and sum(r.record_count for r in got.values()) == sum(range(1, 41))
    for n, r in got.items():
        own = [i for i, x in enumerate(names) if end(x) == n]
        assert r.canonical_brand_name == n.upper() and r.record_count == sum(i + 1 for i in own) and r.total_value == sum(2.0 * i for i in own)
        assert r.raw_brand_names == sorted(x for i in own for x in (names[i], f"{names[i]} x")) and r.aliases == r.raw_brand_names
    rows = spark.createDataFrame([(i, n, n and n.upper(), f"id {n}") for i, n in enumerate([*names, None])], "i int, brand_fingerprint string, normalized_brand string, brand_id string")
    moved = {r.i: r for r in brands.merge_records(rows, master, frame(merges)).collect()}
    ids = {n: h for n, h in spark.createDataFrame([(n,) for n in names], "n string").select("n", F.sha1("n")).collect()}
    assert len(moved) == 41 and moved[40].normalized_brand is None
    for i, n in enumerate(names):
        assert (moved[i].brand_fingerprint, moved[i].normalized_brand, moved[i].brand_id) == (end(n), end(n).upper(), ids[end(n)] if n in up else f"id {n}")
    for bad in ([("b1", "b2"), ("b2", "b3"), ("b3", "b1")], [("b1", "b2"), ("b1", "b3")], [("b1", "b2"), ("b2", "b1")]):
        with pytest.raises(ValueError):
            brands.merge_brands(master, frame(bad))
    assert brands.merge_brands(master, frame([("b1", "b2")]).where("false")).count() == 40


@pytest.mark.parametrize("least", [0, 1, 2])
def test_identity(spark, least):
    rng = random.Random(least)
    words = ["rice", "dal", "brown", "cow", "pure", "fresh", "mini", "maida", "atta", "attar"]
    names = list({" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(150)})
    profile = products.Profile({"brown", "cow"}, {"pure", "fresh", "mini"}, least, ["^(maida|atta)$"])
    rows = [(n, rng.choice(["x", "y", None])) for n in names]
    got = {(r.name, r.cat): r.product for r in products.identity_groups(spark.createDataFrame(rows, "name string, cat string"), profile, "cat").collect()}
    claim = lambda w: w in profile.claims or w in ("maida", "atta")
    def same(a, b):
        a, b = set(a.split()), set(b.split())
        return a == b or (a & profile.identity_words == b & profile.identity_words and all(map(claim, a ^ b)) and len(a & b) >= least)
    root = {r: r for r in rows}
    def find(r):
        while root[r] != r:
            r = root[r]
        return r
    for a, b in product(rows, rows):
        if a[1] == b[1] and same(a[0], b[0]):
            root[find(a)] = find(b)
    members = {}
    for r in rows:
        members.setdefault(find(r), []).append(r[0])
    assert got == {r: min(members[find(r)]) for r in rows} and len(members) < len(rows)
    keys = products.identity_keys(spark.createDataFrame(rows, "name string, cat string"), profile, "cat")
    assert keys.count() < 8 * len(rows)


def test_builtin_profile(spark):
    base = dict(dataset_id="d", _sheet_name="S", brand_id="b", normalized_category="Grocery", upc="", item_id="")
    names = ["Royal Basmati Rice 5kg", "Royal Basmati Rice Premium 10 kg", "Royal Brown Basmati Rice", "Fresh Chakki Wheat Atta", "Chakki Wheat Maida", "Chakki Wheat"]
    df = spark.createDataFrame([{**base, "_source_row": i, "normalized_product_name": n} for i, n in enumerate(names)])
    ids = [r.product_family_id for r in products.group_products(df, profile="grocery_fmcg").orderBy("_source_row").collect()]
    assert ids[0] == ids[1] != ids[2] and ids[3] == ids[4] == ids[5] and len(set(ids)) == 3
    assert len({r.product_family_id for r in products.group_products(df).collect()}) == 6


def test_a_stream_in_disorder_equals_its_batch(spark, tmp_path):
    rng = random.Random(12)
    start = datetime(1970, 1, 2, 20, tzinfo=timezone.utc)
    rows = [(i, rng.choice([1, 2, 3, None]), start + timedelta(seconds=rng.randrange(40_000), microseconds=rng.randrange(3) * 1000), rng.choice(["view", "click", "signup", "purchase", "other"])) for i in range(600)]
    rows += [(1000, 7, start, "view"), (1001, 7, start, "purchase"), (1002, 8, start + timedelta(days=3), "click")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string")
    columns = ["user_id", "event_id", "ts", "since_start", "since_last", "is_progression"]
    expected = Counter(map(tuple, ev.progressions(df).select(*columns).collect()))
    assert Counter(map(tuple, ev.replayed_progressions(df, str(tmp_path / "one"), "4 days").select(*columns).collect())) == expected
    # batch by batch, each in disorder within ten minutes: sessions go on, the watermark passes most of them
    late = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randrange(600)))
    late.append((2000, 99, start + timedelta(days=9), "view"))
    for n in range(0, len(late), 100):
        spark.createDataFrame(late[n : n + 100], df.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n:05}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = ev.progression_stream(stream, "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    assert Counter(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).where("event_id <> 2000").collect())) == expected
