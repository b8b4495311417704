"""Benchmark decontamination: windows of test items, found and verified in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lotwise.llm.common import ascii_lower, fresh, materialize, number_array, sized

#: Java pattern of what separates the words of a lower-cased text.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Java classes of the characters in and outside words of a text whose case is kept.
IN, OUT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: The hash filters in front of the join have about 16 bits a value, from 2**LEAST_BITS to 2**MOST_BITS. A benchmark of more
#: than some 500,000 windows fills them further, so that more windows reach the join, which alone decides.
LEAST_BITS, MOST_BITS = 16, 22


def test_words(text: Column) -> Column:
    """The normalised words of a text: A-Z lower-cased, split at every ASCII character but letters and digits."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def benchmark_windows(bench: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct (item, n, window, anchor): every run of ``width`` item words, or all words of an item with fewer.

    The anchor is the window's longest word, and so most likely its rarest."""
    items = bench.select(F.col(item_col).cast("string").alias("item"), test_words(F.col(text_col)).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("n", F.least(F.lit(width), F.size("w")))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))
    runs = items.select("item", "n", F.explode(runs).alias("run"))
    longest = F.array_max(F.transform("run", lambda x: F.struct(F.length(x).alias("k"), x.alias("x"))))["x"]
    return runs.select("item", "n", F.array_join("run", " ").alias("window"), longest.alias("anchor")).distinct()


class Filter:
    """A hash filter of the distinct strings of a one-column table, as a constant array: 64 bits a number."""

    def __init__(self, values: DataFrame) -> None:
        values = values.toDF("value").distinct()
        self.bits = min(max((16 * values.count()).bit_length(), LEAST_BITS), MOST_BITS)
        bits = values.select(self._bit(F.col("value")).alias("b")).distinct()
        grouped = bits.groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
        filled = dict(map(tuple, grouped.collect()))  # 2**(MOST_BITS - 6) numbers at most
        self.table = number_array((filled.get(i, 0) for i in range(1 << (self.bits - 6))), "bigint")

    def _bit(self, text: Column) -> Column:
        return F.pmod(F.xxhash64(text), F.lit(1 << self.bits))

    def may_have(self, text: Column) -> Column:
        b = self._bit(text)
        return F.getbit(F.get(self.table, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1


def find_hits(docs: DataFrame, bench: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each distinct (id, text_key): n_words, n_rows, spans [(pos, n)] of windows found, items found.

    A document's words are looked up in a hash filter of the anchors of all benchmark windows. The windows around
    the few words that pass go through a second filter and are then joined, as words, to the benchmark's windows
    (broadcast up to a checked size): so every hit is verified. Rows are regrouped without their texts.
    """
    windows = materialize(benchmark_windows(bench, width, item_col, item_text_col))
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # ``width`` values at most
    anchors, whole = Filter(windows.select("anchor")), Filter(windows.select("window"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), test_words(F.col(text_col)).alias("w"))
    at = F.filter(F.transform("w", lambda x, i: F.when(anchors.may_have(x), i + 1)), lambda i: i.isNotNull())
    rows = rows.select("id", "text_key", "w", F.size("w").alias("size"), at.alias("at"))

    def around(n: int) -> Column:
        """The windows of n words that hold a passing word and pass themselves."""
        first, last = (lambda i: F.greatest(i - n + 1, F.lit(1))), (lambda i: F.least(i, F.col("size") - n + 1))
        starts = F.transform(F.filter("at", lambda i: first(i) <= last(i)), lambda i: F.sequence(first(i), F.greatest(first(i), last(i))))
        spelt = F.transform(F.array_distinct(F.flatten(starts)), lambda s: F.struct(s.alias("pos"), F.lit(n).alias("n"), F.array_join(F.slice("w", s, n), " ").alias("window")))
        return F.filter(spelt, lambda x: whole.may_have(x["window"]))

    nothing = F.array().cast("array<struct<pos:int,n:int,window:string>>")
    found = F.when(F.size("at") > 0, F.concat(nothing, *map(around, lengths))).otherwise(nothing)
    each = rows.select("id", "text_key", F.col("size").cast("long").alias("n_words"), F.posexplode_outer(found).alias("j", "f"))
    each = each.select("id", "text_key", "n_words", "j", "f.pos", "f.n", "f.window")
    items = materialize(windows.groupBy("window").agg(F.collect_set("item").alias("items")))
    return (
        each.join(sized(items, weight=F.size("items")), "window", "left")
        .groupBy("id", "text_key", "n_words")
        .agg(
            F.count_if(F.coalesce("j", F.lit(0)) == 0).alias("n_rows"),
            F.array_sort(F.collect_set(F.when(F.col("items").isNotNull(), F.struct("pos", "n")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )


def merged(spans: Column) -> Column:
    """Sorted, possibly overlapping (pos, n) as disjoint (first, end) with exclusive ends."""
    def add(done: Column, x: Column) -> Column:
        last, end = F.element_at(done, -1), x["pos"] + x["n"]
        fresh = F.array(F.struct(x["pos"].alias("first"), end.alias("end")))
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], end).alias("end"))))
        return F.when((F.size(done) > 0) & (last["end"] >= x["pos"]), longer).otherwise(F.concat(done, fresh))
    return F.aggregate(spans, F.array().cast("array<struct<first:int,end:int>>"), add)


def covered(spans: Column) -> Column:
    """How many positions the sorted (pos, n) cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    def add(s: Column, x: Column) -> Column:
        end = x["pos"] + x["n"]
        return F.struct((s["n"] + F.greatest(F.lit(0), end - F.greatest(s["end"], x["pos"]))).alias("n"), F.greatest(s["end"], end).alias("end"))
    return F.aggregate(spans, start, add, lambda s: s["n"])


def decontamination_report(docs: DataFrame, bench: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """What every document shares with a benchmark.

    Words are runs of ASCII letters, digits and non-ASCII characters of the text with A-Z lower-cased. A window is
    ``width`` consecutive words of an item, or the whole of an item with fewer (but some) words; every document word
    inside an occurrence of a window is hit.

    Columns: id, n_words, n_hit, n_items, items_sha256 (of the sorted item ids, comma-joined), contaminated. A null or
    empty text has no words, a null or empty item no window; a null item id is not counted or listed, but its windows
    hit. Each input row gives one row; equal (id, text) rows give equal rows. An empty benchmark hits nothing.
    Extra columns of either table are ignored.
    """
    hits = find_hits(docs, bench, width, id_col, text_col, item_col, item_text_col)
    one = hits.select("id", "n_words", covered(F.col("spans")).cast("long").alias("n_hit"), "items", F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int"))))
    return one.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _joined(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    own, key, cut = fresh(docs, "id"), fresh(docs, "text_key"), [c for c in hits.columns if c not in ("id", "text_key")]
    hit = hits.select(F.col("id").alias(own), F.col("text_key").alias(key), *cut)
    return docs.join(sized(hit, weight=F.size(cut[0]) if cut else None), F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(text_col) == F.col(key)), how)


def drop_contaminated(docs: DataFrame, bench: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without any hit word, with all their columns. Edge cases as in decontamination_report."""
    hits = find_hits(docs, bench, width, id_col, text_col, item_col, item_text_col)
    return _joined(docs, materialize(hits.where(F.size("spans") > 0).select("id", "text_key")), id_col, text_col, "left_anti")


def remove_spans(docs: DataFrame, bench: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All documents, hit words cut out of their texts together with what separates them from the next word.

    Other words, separators and columns stay as they are. Edge cases as in decontamination_report.
    """
    hits = find_hits(docs, bench, width, id_col, text_col, item_col, item_text_col)
    gone = fresh(docs, "cut")
    cut = materialize(hits.where(F.size("spans") > 0).select("id", "text_key", merged(F.col("spans")).alias(gone)))
    wide = _joined(docs, cut, id_col, text_col, "left")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"{IN}+{OUT}*"), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists(gone, lambda c: (c["first"] <= i + 1) & (i + 1 < c["end"])))
    clean = F.concat(F.regexp_extract(text_col, f"^{OUT}*", 0), F.array_join(kept, ""))
    return wide.withColumn(text_col, F.when(F.col(gone).isNotNull(), clean).otherwise(F.col(text_col))).select(*docs.columns)
