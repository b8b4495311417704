"""Conversation structure repair: the cheapest edits that leave a system turn at most, then users and assistants in turn."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lotwise.llm.common import WORD, materialize, sized
from lotwise.llm.line_dedup import BLANKS

#: Costs of the edits Keep, Rerole, Delete and Insert, and of a truncated row that stays.
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
#: States of ``(s?(ua)+)?``: at the start, after the system's turn, after a user's, after an assistant's; where initials lead.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state that a reroled or inserted turn leads to, and its role.
FORCED = (2, 2, 3, 2)
ROLE = ("", "", "user", "assistant")
ENDS = (0, 3)
LEGAL = ("su", "ua", "au")
#: Rows of a conversation are judged in pieces of at most so many; of a piece's texts at most so many characters are held.
PIECE = 4_096
PIECE_CHARS = 16_000_000
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


class Audits:
    """Edit strings as linked nodes that share their prefixes; node 0 is the empty string.

    A node knows its ancestors 1, 2, 4, ... edits up and a rolling hash of its whole string, so two strings are compared
    in logarithmic time at their longest common prefix. Equal hashes are verified, edit by edit, up to a shared node.
    """

    def __init__(self):
        self.edit, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, parent: int, edit: str) -> int:
        up, k = [parent], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.edit.append(edit)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(edit)) % _PRIME)
        self.up.append(up)
        return len(self.edit) - 1

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _ancestor(self, node: int, depth: int) -> int:
        while (gap := self.depth[node] - depth) > 0:
            node = self.up[node][gap.bit_length() - 1]
        return node

    def _equal(self, a: int, b: int) -> bool:
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string of a comes before that of b."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self._ancestor(a, depth), self._ancestor(b, depth)
        if self.hash[x] == self.hash[y]:
            return self.depth[a] < self.depth[b] if self._equal(x, y) else self.text(a) < self.text(b)
        k = len(self.up[x]) - 1
        while k >= 0:
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
            k -= 1
        if not self._equal(self.up[x][0], self.up[y][0]):  # a collision
            return self.text(a) < self.text(b)
        return self.edit[x] < self.edit[y]


def cheapest(symbols: str, start: int) -> list[tuple[int, str] | None]:
    """For each state: cost and least string of the cheapest edits that lead to it from ``start`` over these rows.

    A row is x if it must go, else its role's initial (o for others), in upper case if truncated. Edits determine the
    path, so of two strings that lead to one state at one cost, none begins the other: whatever follows, the lesser
    stays the lesser, and each state needs one string only.
    """
    audits = Audits()
    layer: list[tuple[int, int] | None] = [None] * 4

    def offer(to: list, state: int, cost: int, parent: int, edit: str) -> None:
        held = to[state]
        if held is None or cost < held[0]:
            to[state] = (cost, audits.add(parent, edit))
        elif cost == held[0] and audits.less(node := audits.add(parent, edit), held[1]):
            to[state] = (cost, node)

    def inserted(of: list) -> list:
        left = [s for s in range(4) if of[s]]
        while left:
            s = min(left, key=lambda s: of[s][0])
            left.remove(s)
            to = FORCED[s]
            if of[to] is None:
                left.append(to)
            offer(of, to, of[s][0] + COST["I"], of[s][1], "I")
        return of

    layer[start] = (0, 0)
    layer = inserted(layer)
    for symbol in symbols:
        after: list[tuple[int, int] | None] = [None] * 4
        initial, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
        for s, held in enumerate(layer):
            if held:
                cost, node = held
                offer(after, s, cost + COST["D"], node, "D")
                if symbol != "x":
                    offer(after, FORCED[s], cost + COST["R"] + extra, node, "R")
                    if (to := NEXT[s].get(initial)) is not None:
                        offer(after, to, cost + COST["K"] + extra, node, "K")
        layer = inserted(after)
    return [held and (held[0], audits.text(held[1])) for held in layer]


_known: dict = {}  # of a worker: short conversations look alike


def _cheapest(symbols: str, start: int) -> list[tuple[int, str] | None]:
    if len(symbols) > 64:
        return cheapest(symbols, start)
    if (symbols, start) not in _known:
        if len(_known) >= 1 << 14:
            _known.clear()
        _known[symbols, start] = cheapest(symbols, start)
    return _known[symbols, start]


class Repaired:
    """Hash of the repaired rows, fed with edits and then with the rows that they are for."""

    def __init__(self):
        self.state, self.edits, self.at, self.hash, self.some = 0, "", 0, hashlib.sha256(), False

    def _line(self, state: int, role: str, text: str) -> None:
        self.state = state
        self.hash.update(f"{chr(10) * self.some}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.some = True

    def _inserts(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            self._line(FORCED[self.state], ROLE[FORCED[self.state]], "")

    def expect(self, edits: str) -> None:
        self._inserts()
        self.edits, self.at = edits, 0

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit == "K":
            self._line(NEXT[self.state][role[:1]], role, text)
        elif edit == "R":
            self._line(FORCED[self.state], ROLE[FORCED[self.state]], text)

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(0, b.num_rows, 512):
            yield from b.slice(i, 512).to_pylist()


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == 512:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _runs(rows: Iterator[dict], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows that follow each other with equal keys, as streams."""
    row = next(rows, None)
    while row is not None:
        key = tuple(row[k] for k in keys)

        def same() -> Iterator[dict]:
            nonlocal row
            while row is not None and tuple(row[k] for k in keys) == key:
                yield row
                row = next(rows, None)

        run = same()
        yield key, run
        for _ in run:
            pass


def _piece(rows: Iterator[dict]) -> tuple:
    """Counts, turns, edge initials, cheapest edits from state to state, and the hash as if these were all rows."""
    symbols, n, texts, chars, illegal, distinct = [], {"blank": 0, "duplicate": 0, "truncated": 0}, [], 0, 0, 0
    first = last = None
    low = high = None
    for r in rows:
        initial = r["role"][:1]
        if last is None:
            first = initial
        elif last + initial not in LEGAL:
            illegal += 1
        last = initial
        if r["fault"]:
            n[r["fault"]] += 1
        known = initial if initial in ("s", "u", "a") else "o"
        symbols.append("x" if r["fault"] in ("blank", "duplicate") else known.upper() if r["fault"] else known)
        if (turn := r["turn"]) is not None and turn != high:  # turns ascend
            low, high, distinct = turn if low is None else low, turn, distinct + 1
        chars += len(r["text"])
        if chars <= PIECE_CHARS:
            texts.append((r["role"], r["text"]))
    found = [_cheapest("".join(symbols), s) for s in range(4)]
    digest = None
    if chars <= PIECE_CHARS:
        whole = Repaired()
        whole.expect(min(found[0][s] for s in ENDS if found[0][s])[1])
        for row in texts:
            whole.row(*row)
        digest = whole.digest()
    flat = [x for row in found for x in row]
    return (*n.values(), illegal, first, last, low, high, distinct, [x and x[0] for x in flat], [x and x[1] for x in flat], digest)


def _joined(pieces: Iterator[dict]) -> tuple:
    """The whole of a conversation's pieces; strings of pieces are linked, and compared from where they part."""
    total, illegal, distinct = [0, 0, 0], 0, 0
    low = high = last = digest = None
    n, best = 0, {0: (0, None)}

    def strings(a, b) -> tuple[str, str]:
        left, right = [], []
        while a is not b:
            left.append(a[1])
            right.append(b[1])
            a, b = a[0], b[0]
        return "".join(reversed(left)), "".join(reversed(right))

    for p in pieces:
        n += 1
        total = [a + b for a, b in zip(total, (p["blank"], p["duplicate"], p["truncated"]))]
        illegal += p["illegal"] + (last is not None and last + p["first"] not in LEGAL)
        last = p["last"]
        if p["low"] is not None:
            distinct += p["turns"] - (high == p["low"])
            low, high = p["low"] if low is None else low, p["high"]
        after: dict = {}
        for s, (cost, node) in best.items():
            for to in range(4):
                more = p["costs"][4 * s + to]
                if more is None:
                    continue
                entry, held = (cost + more, (node, p["audits"][4 * s + to], p["block"])), after.get(to)
                if held is None or entry[0] < held[0] or entry[0] == held[0] and (x := strings(entry[1], held[1]))[0] < x[1]:
                    after[to] = entry
        best, digest = after, p["digest"]
    ends = [best[s] for s in ENDS if s in best]
    cost, node = min(ends, key=lambda e: e[0])
    for other in ends:
        if other[0] == cost and (x := strings(other[1], node))[0] < x[1]:
            node = other[1]
    parts = []
    while node:
        parts.append({"block": node[2], "edits": node[1]})
        node = node[0]
    parts.reverse()
    audit = "".join(p["edits"] for p in parts)
    gaps = 0 if low is None else high - low + 1 - distinct
    return gaps, *total, illegal, cost, audit, digest if n == 1 else None, [] if n == 1 and digest else parts


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults put in by crc32 of ``conv:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 makes it a user's. Null roles and
    texts become one space, and so do nulls under the hash.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text, role = F.coalesce(F.col(text_col), blank), F.coalesce(F.col(role_col), blank)
    out = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("kind"),
    ).where("kind <> 0")
    return out.select("conv", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Audits conversations and repairs them by the cheapest edits that give role initials ``(s?(ua)+)?``.

    Rows are taken by turn, nulls first; ties by role and text. A row's first fault counts: blank (no word), duplicate
    (role and text seen earlier in the conversation), truncated (the last character is none of ``.!?``). Keep costs 0,
    Rerole to user or assistant 2, Delete 3 (blanks and duplicates must go), Insert an empty user's or assistant's turn 2; a
    truncated row that stays adds 1. Of equally cheap edits the least string in ASCII is taken.

    Rows are range-partitioned by conversation and turn, so a conversation of any length spreads over tasks, and cut into
    pieces of at most PIECE rows. A piece gives the cheapest edits between any two states (see cheapest); pieces of a
    conversation are joined like matrices. Only conversations of several pieces, or with very long texts, are read once
    more for their hash, as a stream. What a task holds of a conversation is its edits, which are one cell of the result.

    Columns: conv, gaps (missing turns between least and largest, nulls ignored), blank, duplicate, truncated, illegal
    (adjacent role initials other than su, ua, au), cost, audit (initials of the edits), repaired_sha256 (repaired
    ``role:text``, joined by \\n). Null roles and texts must be replaced before; null conversation ids are one
    conversation. An empty table gives an empty result; extra columns are ignored.
    """
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    again = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    stop = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1).isin(".", "!", "?")
    rows = rows.withColumn("again", again).withColumn("fault", F.when(~F.col("text").rlike(WORD), "blank").when(F.col("again"), "duplicate").when(~stop, "truncated"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text", "again").withColumn("at", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("block", F.floor(F.col("at") / PIECE)).select("conv", "block", "at", "turn", "role", "text", "fault"))

    key = T.StructField("conv", rows.schema["conv"].dataType)
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    strings = lambda *names: [T.StructField(n, T.StringType()) for n in names]
    piece = T.StructType([key, *longs("block", "blank", "duplicate", "truncated", "illegal"), *strings("first", "last"), *longs("low", "high", "turns"), T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType())), *strings("digest")])
    parts = T.ArrayType(T.StructType([*longs("block"), *strings("edits")]))
    whole = T.StructType([key, *longs("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), *strings("audit", "digest"), T.StructField("parts", parts)])
    hashed = T.StructType([key, *strings("digest2")])
    piece_arrow, whole_arrow, hashed_arrow = to_arrow_schema(piece), to_arrow_schema(whole), to_arrow_schema(hashed)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((*k, *_piece(run)) for k, run in _runs(_rows(batches), "conv", "block")), piece_arrow)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((*k, *_joined(run)) for k, run in _runs(_rows(batches), "conv")), whole_arrow)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            for k, run in _runs(_rows(batches), "conv"):
                out = Repaired()
                for r in run:
                    if r["edits"] is not None:
                        out.expect(r["edits"])
                    else:
                        out.row(r["role"], r["text"])
                yield *k, out.digest()
        return _batches(digests(), hashed_arrow)

    cut = rows.repartition("conv", "block").sortWithinPartitions("conv", "block", "at").mapInArrow(pieces, piece)
    found = materialize(cut.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(join, whole))
    later = materialize(found.where(F.size("parts") > 0).select("conv", F.explode("parts").alias("p")).select(F.col("conv").alias("p_conv"), F.col("p.block").alias("p_block"), F.col("p.edits").alias("edits")))
    there = F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("block") == F.col("p_block"))
    turns = rows.join(sized(later.select("p_conv", "p_block")), there, "left_semi").select("conv", "block", "at", F.lit(None).cast("string").alias("edits"), "role", "text")
    fed = turns.unionByName(later.select(F.col("p_conv").alias("conv"), F.col("p_block").alias("block"), F.lit(-1).cast("long").alias("at"), "edits", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))
    more = fed.repartition("conv").sortWithinPartitions("conv", "block", "at").mapInArrow(stream, hashed).withColumnRenamed("conv", "h_conv")
    out = found.join(more, F.col("conv").eqNullSafe(F.col("h_conv")), "left")
    return out.select(F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("digest2", "digest").alias("repaired_sha256"))


def damaged_and_repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """repair() of what damaged() leaves; a conversation without rows after that has zeros and the hash of nothing."""
    ids = rows.select(F.col(conv_col).alias("own")).distinct()
    found = repair(damaged(rows, conv_col, turn_col, role_col, text_col), "conv", "turn", "role", "text")
    out = ids.join(found, F.col("own").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("own").alias(conv_col), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
