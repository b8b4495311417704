"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lotwise.llm.common import fresh, materialize, sized, word_count

#: No document is taken more often.
MOST_COPIES = 3
#: Sources are metadata that the driver holds: more is an error, never a silent cut.
MOST_SOURCES = 100_000
NEWTON_STEPS = 80


def targets(sizes: list[int], weights: list[float], most: float = MOST_COPIES) -> list[float]:
    """Shares of the summed sizes by weight, none above ``most`` times its size; the excess is reshared by weight."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def tilt(cells: DataFrame, goal: dict[int, float], total: dict[int, int], scale: dict[int, float]) -> dict[int, float]:
    """Solves the dual, one multiplier a source: sum of n * size * min(3, exp(multiplier * size / scale)) = target.

    Every step sums gradient and curvature of all sources over all cells in one Spark aggregation; sums are decimal,
    so that they do not depend on the order of partitions. A step that leaves the bracket known so far is bisected.
    """
    free = {s for s, t in goal.items() if 0 < t < MOST_COPIES * total[s] * (1 - 1e-12)}
    at = {s: math.log(goal[s] / total[s]) if s in free else (math.inf if total[s] else 0.0) for s in goal}
    low, high = dict.fromkeys(free, -math.inf), dict.fromkeys(free, math.inf)
    spark, moving = cells.sparkSession, set(free)
    for _ in range(NEWTON_STEPS):
        if not moving:
            break
        here = spark.createDataFrame([(s, at[s], scale[s]) for s in sorted(moving)], "sid int, multiplier double, scale double")
        z = F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(MOST_COPIES)), F.exp(F.least(F.col("multiplier") * z, F.lit(2.0))))
        mass = F.col("n") * F.col("size") * rate
        exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
        sums = cells.join(F.broadcast(here), "sid").groupBy("sid").agg(exact(mass).alias("g"), exact(F.when(rate < MOST_COPIES, mass * z).otherwise(0.0)).alias("h"))
        for sid, g, h in sums.collect():
            off = g - goal[sid]
            if abs(off) <= max(1e-9 * goal[sid], 1e-3):
                moving.discard(sid)
                continue
            (high if off > 0 else low)[sid] = at[sid]
            step = at[sid] - off / h if h > 0 else math.nan
            if not low[sid] < step < high[sid]:
                a, b = low[sid], high[sid]
                step = (a + b) / 2 if math.isfinite(a) and math.isfinite(b) else (at[sid] + 2 * abs(at[sid]) + 1 if off < 0 else at[sid] - 2 * abs(at[sid]) - 1)
            if step == at[sid] or high[sid] - low[sid] < 1e-14:
                moving.discard(sid)
            at[sid] = step
    return {s: float(f"{v:.12g}") for s, v in at.items()}


def _copies(cells: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for one source's cells, longest documents first; what a cell rounds away passes to the next."""
    cells = cells.sort_values("size", ascending=False)
    carry, made = 0.0, []
    for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
        carry += n * rate * size
        m = min(max(math.floor(carry / size + 0.5), 0), MOST_COPIES * n) if size else n
        carry -= m * size
        made.append(m)
    return cells[["sid", "size", "n"]].assign(copies=made)


def mix_plan(rows: DataFrame, weights: tuple[float, ...]) -> tuple[DataFrame, DataFrame]:
    """From materialised rows (id, source, size, pick): the sources (sid, source, source_size, target), and the cells
    (source, size, base, cutoff): a row is taken base times, and once more if its pick is at most the cutoff."""
    spark = rows.sparkSession
    counts = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    found = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("total"), F.sum(F.col("n") * F.col("size").cast("double") ** 2).alias("square")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # Python compares strings by code point
    total = {i: r["total"] for i, r in enumerate(found)}
    goal = dict(enumerate(targets(list(total.values()), [weights[i % len(weights)] for i in total])))
    scale = {i: r["square"] / r["total"] if r["total"] else 1.0 for i, r in enumerate(found)}
    sources = spark.createDataFrame([(i, r["source"], total[i], goal[i]) for i, r in enumerate(found)], "sid int, source string, source_size long, target double")
    cells = counts.join(F.broadcast(sources.select("sid", F.col("source").alias("s"))), F.col("source").eqNullSafe(F.col("s"))).select("sid", "size", "n")
    at = tilt(cells, goal, total, scale)
    solved = spark.createDataFrame([(s, at[s] if math.isfinite(at[s]) else None, scale[s]) for s in at], "sid int, multiplier double, scale double")
    tilted = F.least(F.lit(float(MOST_COPIES)), F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("scale"), F.lit(2.0))))
    rated = cells.join(F.broadcast(solved), "sid").select("sid", "size", "n", F.when(F.col("multiplier").isNull(), float(MOST_COPIES)).otherwise(tilted).alias("rate"))
    # a source has fewer distinct sizes than the root of twice its words: its cells fit one task at any row count
    whole = materialize(rated.groupBy("sid").applyInPandas(_copies, "sid int, size long, n long, copies long"))
    base = F.floor(F.col("copies") / F.col("n")).cast("int")
    whole = whole.select("sid", "size", base.alias("base"), (F.col("copies") - base * F.col("n")).alias("extra"))
    whole = whole.join(F.broadcast(sources.select("sid", "source")), "sid").select("source", "size", "base", "extra")

    # the extra copies of a cell go to its smallest picks: find the part of the pick range that holds the last one, then it
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size"))
    some = whole.where("extra > 0").select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), "extra")
    picks = rows.join(sized(some), same).select("source", "size", "extra", "pick", F.shiftright("pick", 54).alias("part"))
    cell = ["source", "size"]
    parts = picks.groupBy(*cell, "extra", "part").agg(F.count("*").alias("n"))
    upto = parts.withColumn("upto", F.sum("n").over(W.partitionBy(*cell).orderBy("part")))
    last = materialize(upto.where("upto >= extra and upto - n < extra").select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("part").alias("c_part"), (F.col("extra") - F.col("upto") + F.col("n")).alias("nth")))
    near = picks.join(sized(last), same & (F.col("part") == F.col("c_part")))
    nth = near.withColumn("rank", F.row_number().over(W.partitionBy(*cell, "part").orderBy("pick"))).where("rank = nth")
    cutoff = nth.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("pick").alias("cutoff"))
    return sources, materialize(whole.join(cutoff, same, "left").select("source", "size", "base", "cutoff"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document goes into a mix whose sources have given shares of all words.

    Sources in code-point order, null last, weigh ``weights``, repeating. A source's target is its share of all words,
    at most 3 times its own, the excess reshared by weight. The rates nearest to 1 in entropy that meet all targets are
    exp(multiplier of the source * size), at most 3; distributed Newton steps over the (source, size) histogram solve
    for the multipliers. Rates become whole copies by passing each cell's rounding error to the next shorter cell,
    so that a source ends within about one short document of its target.

    Columns: id, source, size, source_size, target, copies, taken (copies * size). Rows that share id and text
    share a fate. A document without words has size 0 and one copy. A null or empty source name is a source of its
    own. An empty table gives an empty result. Extra columns are ignored. The same input gives the same result.
    """
    rows = materialize(mix_rows(docs, id_col, text_col, source_col))
    sources, cells = mix_plan(rows, weights)
    return (
        with_copies(rows, cells)
        .join(F.broadcast(sources.select(F.col("source").alias("s"), "source_size", "target")), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
    )


def mix_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, pick) of every row; pick orders a cell's rows by a hash of id and text, nulls among them."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit("pick"), F.col(id_col), F.col(text_col)).alias("pick"))


def with_copies(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds copies to rows that have source, size and pick. Every row keeps its place in its cell; null sources match null."""
    named = cells.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), "base", "cutoff")
    joined = rows.join(sized(named), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")))
    copies = F.col("base") + F.when(F.col("pick") <= F.col("cutoff"), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("int")).drop("c_source", "c_size", "base", "cutoff")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of the input.

    A row's copies follow from its own source, text and id and a table of cells, so texts are never shuffled
    while that table is small enough to broadcast. A text without words is taken once, a null source is one of its own,
    rows that share id and text share a fate, and an empty table gives an empty result.
    """
    rows = materialize(mix_rows(docs, id_col, text_col, source_col))
    _, cells = mix_plan(rows, weights)
    key = {c: fresh(docs, c) for c in ("source", "size", "pick", "c_source", "c_size", "base", "cutoff", "copy")}
    wide = docs.withColumns({key["source"]: F.col(source_col), key["size"]: word_count(F.col(text_col)), key["pick"]: F.xxhash64(F.lit("pick"), F.col(id_col), F.col(text_col))})
    named = cells.select(F.col("source").alias(key["c_source"]), F.col("size").alias(key["c_size"]), F.col("base").alias(key["base"]), F.col("cutoff").alias(key["cutoff"]))
    joined = wide.join(sized(named), F.col(key["source"]).eqNullSafe(F.col(key["c_source"])) & (F.col(key["size"]) == F.col(key["c_size"])))
    copies = F.col(key["base"]) + F.when(F.col(key["pick"]) <= F.col(key["cutoff"]), 1).otherwise(0)
    return joined.withColumn(key["copy"], F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*docs.columns)
