"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lotwise.llm.common import fresh, materialize, number_array, sized, spaced, words

#: Hash buckets of the multinomials; their counts are all that reaches the driver.
BUCKETS = 1 << 14
#: Of the trusted documents one in so many is held out of the multinomial; all of these give the cut.
HELD_OUT = 4
#: The cut is this quantile of the held-out documents' mean log-likelihood ratios.
QUANTILE = 0.02
#: A pass for a quantile counts so many parts of a range.
PARTS = 1 << 12
#: Scores count from the cut, so a document is kept from 0 up.
THRESHOLD = 0.0
WINDOW = 8


def _pairs(hashes: Column, gap: int) -> Column:
    """Hashes of the runs twice as long: each joined with the one ``gap`` places on."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - gap, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(hashes, i + gap)))


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """For each bucket log p(bucket | trusted) - log p(bucket | all), over the hashed words and word pairs.

    ``trusted`` holds ids, each once. Both multinomials are smoothed towards the raw corpus, so that a bucket that
    is rare in the trusted part says little.
    """
    rows = marked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), trusted.select(F.col(id_col).alias("id")), "id", "good").select("good", _hashes(words(F.col("text"))).alias("h"))
    grams = rows.select("good", F.explode(F.concat("h", _pairs(F.col("h"), 1))).alias("h")).select("good", _bucket(F.col("h")).alias("b"))
    counts = {r["b"]: (r["n"], r["g"]) for r in grams.groupBy("b").agg(F.count("*").alias("n"), F.count_if("good").alias("g")).collect()}
    raw, good = sum(n for n, _ in counts.values()), sum(g for _, g in counts.values())
    if not good:
        return [0.0] * BUCKETS
    prior = 4.0  # occurrences that a bucket has in the trusted part before any is seen, on average, dealt out as in all
    out = []
    for b in range(BUCKETS):
        n, g = counts.get(b, (0, 0))
        p = (n + 1) / (raw + BUCKETS)
        out.append(math.log((g + prior * BUCKETS * p) / (good + prior * BUCKETS) / p))
    return out


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of all documents labelled good and not toxic, each once."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(id_col).where(F.col(id_col).isNotNull()).distinct()


def marked(docs: DataFrame, ids: DataFrame, id_col: str, mark: str) -> DataFrame:
    """The documents with a column that says whether a row's id is among ``ids``, a materialised table with each once.

    Of ids that are whole numbers 64 neighbours share a row of bits, so that texts are not shuffled for a set of up to 32
    million dense ids; ids of another type, or of more such rows, meet the texts in a shuffle join with equal results."""
    key, value = fresh(docs, "key"), fresh(docs, "value")
    if all(isinstance(df.schema[id_col].dataType, T.IntegralType) for df in (docs, ids)):
        number = F.col(id_col).cast("long")
        word, place = F.shiftright(number, 6), number.bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
        found = materialize(ids.groupBy(word.alias(key)).agg(F.bit_or(bit).alias(value)))
        within = F.getbit(value, place) == 1
    else:
        word, found, within = F.col(id_col), ids.select(F.col(id_col).alias(key), F.lit(1).alias(value)), F.col(value) == 1
    return docs.join(sized(found), word == F.col(key), "left").withColumn(mark, F.coalesce(within, F.lit(False))).drop(key, value)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value bound to its argument, and so computed once however often the body names it.

    A verdict in one expression can be a filter; one made of columns on columns would be copied into the filter at
    every level when Spark pushes it down."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quantile(values: DataFrame, share: float) -> float | None:
    """The exact quantile of a materialised column ``x`` of finite numbers, linear between neighbours; None without any.

    A pass counts the values in equal parts of the range that holds the wanted one and goes on within its part, so that no
    task and no group holds the values themselves.
    """
    x = F.col("x")
    n, low, high = values.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return None
    place, below = share * (n - 1), 0
    nth = math.floor(place)
    while low < high:
        part = F.least(F.floor((x - low) / (high - low) * PARTS), F.lit(PARTS - 1))
        for r in values.where(x.between(low, high)).groupBy(part.alias("part")).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).orderBy("part").collect():
            if below + r["n"] > nth:
                low, high = r["low"], r["high"]
                break
            below += r["n"]
    if place == nth:
        return low
    upto, after = values.agg(F.count_if(x <= low), F.min(F.when(x > low, x))).first()
    return (nth + 1 - place) * low + (place - nth) * (low if upto > nth + 1 else after)


def learnt(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[float], float]:
    """The ratios of the buckets, and the cut: a low quantile of what trusted documents score that were not learnt from.

    Scores shrink as the corpus grows and the trusted part with it; the cut follows them, so that at any size about
    the same share of good documents passes. Every held-out document is scored but those that fail a base rule. Without
    held-out documents the trusted ones themselves are scored; without any the cut is 0.
    """
    trusted = materialize(trusted_ids(labels, id_col=id_col))
    draw = F.pmod(F.xxhash64(F.lit("held"), F.col(id_col)), F.lit(1 << 30))
    held = materialize(trusted.where(draw < (1 << 30) // HELD_OUT))
    ratios = log_ratios(docs, materialize(trusted.where(draw >= (1 << 30) // HELD_OUT)), id_col, text_col)
    if not any(ratios):
        return ratios, 0.0
    asked = trusted if held.isEmpty() else held
    scored = marked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), asked.select(F.col(id_col).alias("id")), "id", "asked").where("asked")
    # written before it is filtered: a filter would be pushed below the join and judge every document
    scored = materialize(scored.select(judgement(F.col("text"), ratios).alias("j")))
    return ratios, quantile(scored.where("not j.base_failed").select(F.col("j.score").alias("x")), QUANTILE) or 0.0


def judgement(text: Column, ratios: list[float], cut: float = 0.0) -> Column:
    """Statistics, score (from the cut) and verdict of a text as one struct."""
    t = marks = F.coalesce(text, F.lit(""))
    for c in "#*$%&|<>":
        marks = F.replace(marks, F.lit(c), F.lit(""))
    n_dup_lines = _let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))
    table = number_array((f"{x:.6g}" for x in ratios), "double")
    add = lambda acc, x: acc + F.get(table, _bucket(x))

    def covered(order: Column) -> Column:
        """Words in windows whose hash another window has: neighbours in hash order."""
        same = lambda k, x: F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))
        again = F.filter(F.transform(order, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"])), lambda i: i.isNotNull())
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(F.sort_array(again), start, lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"), (i + WINDOW).alias("end")), lambda s: s["n"])

    def repeated(four: Column) -> Column:
        """A repeated window of eight words has a repeated run of four, so most texts stop there."""
        twice = lambda a: F.size(F.array_distinct(a)) < F.size(a)
        order = lambda eight: F.array_sort(F.transform(eight, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(twice(four), _let(_pairs(four, 4), lambda eight: F.when(twice(eight), _let(order(eight), covered)).otherwise(0))).otherwise(0)

    def verdict(pieces: Column, h: Column, two: Column) -> Column:
        n, score = F.size(h), F.aggregate(two, F.aggregate(h, F.lit(0.0), add), add) / F.greatest(2 * F.size(h) - 1, F.lit(1)) - F.lit(cut)
        def judged(s: Column) -> Column:
            failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
            return F.struct(*(s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed.alias("base_failed"), (~failed & (s["score"] >= THRESHOLD)).alias("kept"), s["score"].alias("score"))
        counted = F.struct(
            n.cast("long").alias("n_words"),
            (F.length(t) - F.size(pieces) + 1).cast("long").alias("word_chars"),
            (F.length(t) - F.length(marks)).cast("long").alias("n_symbols"),
            n_dup_lines.cast("long").alias("n_dup_lines"),
            _let(_pairs(two, 2), repeated).cast("long").alias("n_repeat_words"),
            score.alias("score"),
        )
        return _let(counted, judged)

    return _let(F.split(spaced(text), " "), lambda pieces: _let(_hashes(F.array_remove(pieces, "")), lambda h: _let(_pairs(h, 1), lambda two: verdict(pieces, h, two))))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judges every document by base rules and by the hashed n-gram log-likelihood ratio of trusted to raw text.

    Two multinomials over hashed words and word pairs are estimated: from the documents labelled good and not toxic
    (the trusted target: all but those held out for the cut), and from all documents. A document's score is the sum of log
    ratios of its n-grams over their number, less the cut (see learnt); it is kept if no base rule fails and the score
    reaches THRESHOLD.

    Columns: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score. A null or
    empty text has no words and fails. Every row is judged alone, so ties and repeated rows get equal results.
    Without a trusted document all ratios are 0 and only the base rules decide. An empty table gives an empty
    result; extra columns of either table are ignored. Null labels are not trusted; a null toxic counts as 0.
    """
    ratios, cut = learnt(docs, labels, id_col, text_col)
    return docs.select(F.col(id_col), judgement(F.col(text_col), ratios, cut).alias("__j")).select(id_col, "__j.*")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that quality_rules keeps, with their own columns. Judged and filtered in one pass over the texts.

    Null and short texts go, equal rows share a fate, an empty table stays empty; nulls in other columns do not matter.
    """
    ratios, cut = learnt(docs, labels, id_col, text_col)
    return docs.where(judgement(F.col(text_col), ratios, cut)["kept"])
