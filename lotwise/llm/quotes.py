"""Chat formatting: quotation linking of messages into reply-ordered threads without quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lotwise.llm.common import materialize

#: Quote marks at the start of a line, as in mail; the number of > is the level.
MARKS = r"^[\x20\t]*(?:>[\x20\t]*)+"
#: A line that introduces a quote.
ATTRIBUTION = r"(?i)(?:\bwrote|\bschrieb|\ba écrit|\bescribió)[\x20\xA0]?:[\x20\t]*$"
#: Replies to one message are put in order in blocks of so many turns, so that no task holds all of them.
BLOCK = 1024
_BREAK = "\x01"


def normalised(text: Column) -> Column:
    """Lower case, with single spaces: how passages are compared."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\s\x01]+", " ")))


def parsed_lines(text: Column) -> Column:
    """The lines as an array of (level, content)."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), "\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"[^>]", ""))
    return F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("content")))


def passages(lines: Column) -> Column:
    """Runs of non-blank lines of one level, as an array of (level, passage), normalised."""
    blank = lambda x: normalised(x["content"]) == ""
    def mark(x: Column, i: Column) -> Column:
        last = F.get(lines, i - 1)
        fresh = (i == 0) | (last["level"] != x["level"]) | blank(last)
        content = normalised(x["content"])
        return F.when(blank(x), F.lit("")).when(fresh, F.concat(F.lit(_BREAK), x["level"].cast("string"), F.lit(":"), content)).otherwise(F.concat(F.lit(" "), content))
    runs = F.filter(F.split(F.array_join(F.transform(lines, mark), ""), _BREAK), lambda p: p != "")
    return F.transform(runs, lambda p: F.struct(F.substring_index(p, ":", 1).cast("int").alias("level"), F.regexp_replace(p, r"^\d+:", "").alias("passage")))


def reply_order(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(conv, turn, place) of every linked message and of the first messages of their threads: its place when a thread is read
    from its first message, every message before its replies and replies by turn.

    The tour that enters and leaves every message in this order is a list, and places are ranks in it, found by
    doubling jumps: as many rounds as the logarithm of the longest thread, all joins on unique keys.
    """
    block = F.floor(F.col("turn") / BLOCK)
    inside = W.partitionBy("conv", "reply_to", "block").orderBy("turn")
    sibling = links.select("conv", "turn", "reply_to", block.alias("block")).withColumn("next", F.lead("turn").over(inside))
    starts = sibling.groupBy("conv", "reply_to", "block").agg(F.min("turn").alias("start"))
    starts = starts.withColumn("later", F.lead("start").over(W.partitionBy("conv", "reply_to").orderBy("block"))).select("conv", "reply_to", "block", "later")
    sibling = sibling.join(starts, ["conv", "reply_to", "block"]).select("conv", "turn", F.col("reply_to").alias("up"), F.coalesce("next", "later").alias("next"))
    child = links.groupBy("conv", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = sibling.unionByName(roots.select("conv", "turn"), allowMissingColumns=True).join(child, ["conv", "turn"], "left")
    enter = F.struct(F.col("turn") * 2, F.coalesce(F.col("child") * 2, F.col("turn") * 2 + 1), F.lit(1).cast("long"))
    leave = F.struct(F.col("turn") * 2 + 1, F.coalesce(F.col("next") * 2, F.col("up") * 2 + 1), F.lit(0).cast("long"))
    kind = "array<struct<at:bigint,then:bigint,ahead:bigint>>"
    tour = materialize(nodes.select("conv", F.inline(F.array(enter, leave).cast(kind))))
    while True:
        on = tour.select("conv", F.col("at").alias("then"), F.col("then").alias("then2"), F.col("ahead").alias("more"))
        further = materialize(tour.join(on, ["conv", "then"], "left").select("conv", "at", F.col("then2").alias("then"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead")))
        ended = further.where("then is not null").isEmpty()
        tour = further
        if ended:
            break
    return tour.where("at % 2 = 0").select("conv", F.shiftright("at", 1).alias("turn"), "ahead")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages without their quotes, each with the message that it answers and the thread that it belongs to.

    Quote levels are parsed from leading > marks. Passages (runs of lines of one level) and their single lines are
    normalised and hashed, and joined, within a conversation, to the earliest message whose whole body they are, else to
    the earliest that has the same passage or line among its own words, however short. A message answers the earlier message whose words it quotes at
    the lowest level; of several the one with most quoted characters, then the latest, so that a chance match of a short
    line yields to a longer passage. Threads follow these links to their first message. A conversation in reply order is
    its rows by (thread, place). Hashes have 128 bits; the cost of a message grows in proportion to its lines.

    Columns: conv id, turn, role, reply_to (turn, null without a link), thread (turn of the thread's first message),
    depth (links up to it), place (0 up in the thread: every message before its replies, replies by turn), quote_level (deepest), n_quoted (lines), body (own lines; lines that only introduce a
    quote go as well). A null text has an empty body. Messages without an id or turn keep their bodies and link
    nowhere. Rows that share conversation and turn share links. Identical bodies, and identical passages, belong to
    the earliest message. An empty table gives an empty result; extra columns are ignored.
    """
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), parsed_lines(F.col(text_col)).alias("lines"))
    rows = rows.withColumn("quoted", F.filter("lines", lambda x: x["level"] > 0)).withColumn("passages", passages(F.col("lines")))
    kept = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(x["content"].rlike(ATTRIBUTION) & (F.coalesce(F.get("lines", i + 1)["level"], F.lit(0)) > 0)))
    own = F.transform(kept, lambda x: x["content"])
    single = F.transform("lines", lambda x: F.struct(x["level"].alias("level"), normalised(x["content"]).alias("passage")))
    body = F.struct(F.lit(-1).alias("level"), normalised(F.array_join(own, " ")).alias("passage"))
    # strings: distinct ones are found by hashing, structs by comparing all with all
    spelt = lambda x: F.when(x["passage"] == "", "").otherwise(F.concat_ws(":", x["level"], F.xxhash64(x["passage"]), F.xxhash64(F.lit(1), x["passage"]), F.length(x["passage"])))
    units = rows.where(F.col("conv").isNotNull() & F.col("turn").isNotNull()).select("conv", "turn", F.explode(F.array_distinct(F.transform(F.concat("passages", single, F.array(body)), spelt))).alias("u"))
    units = units.where("u <> ''").select("conv", "turn", F.split("u", ":").alias("u"))
    level, hash_, hash2, chars = (F.get("u", F.lit(i)).cast(kind) for i, kind in enumerate(("int", "long", "long", "int")))
    units = units.select("conv", "turn", level.alias("level"), hash_.alias("hash"), hash2.alias("hash2"), chars.alias("chars"))
    quotes = units.where("level > 0")
    origins = units.where("level <= 0").groupBy("conv", "hash", "hash2").agg(F.min("turn").alias("any"), F.min(F.when(F.col("level") < 0, F.col("turn"))).alias("whole"))  # level -1: a whole body
    votes = quotes.join(origins, ["conv", "hash", "hash2"]).withColumn("origin", F.when(F.col("whole") < F.col("turn"), F.col("whole")).otherwise(F.col("any"))).where("origin < turn").groupBy("conv", "turn", "level", "origin").agg(F.sum("chars").alias("chars"))
    best = votes.groupBy("conv", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), F.col("chars"), F.col("origin"))).alias("reply_to"))
    links = materialize(best)

    # every message's jump doubles each round until all end at a thread's first message
    jumps = links.select("conv", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth"))
    while True:
        next_ = jumps.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        further = materialize(jumps.join(next_, ["conv", "up"], "left").select("conv", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")))
        moved = not further.where("moved").isEmpty()
        jumps = further.drop("moved")
        if not moved:
            break
    roots = materialize(jumps.groupBy("conv", F.col("up").alias("turn")).agg(F.count("*").alias("below")))
    order = reply_order(links, roots)
    linked = links.join(jumps, ["conv", "turn"]).join(order, ["conv", "turn"]).join(roots.select("conv", F.col("turn").alias("up"), "below"), ["conv", "up"])
    place = F.col("below") + 1 - F.col("ahead")
    linked = linked.select(F.col("conv").alias("l_conv"), F.col("turn").alias("l_turn"), "reply_to", "up", "depth", place.alias("place"))
    text = F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["content"]), "\n"), r"^\n+|\n+$", "")
    plain = rows.select("conv", "turn", "role", F.coalesce(F.array_max(F.transform("quoted", lambda x: x["level"])), F.lit(0)).alias("quote_level"), F.size("quoted").alias("n_quoted"), text.alias("body"))
    joined = plain.join(linked, (F.col("conv") == F.col("l_conv")) & (F.col("turn") == F.col("l_turn")), "left")
    return joined.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        "reply_to",
        F.coalesce("up", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("place", F.lit(0)).cast("long").alias("place"),
        F.col("quote_level").cast("int").alias("quote_level"),
        F.col("n_quoted").cast("int").alias("n_quoted"),
        "body",
    )
