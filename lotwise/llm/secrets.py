"""Secret scans: known patterns, and literals assigned to sensitive names in source and configuration text."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CUES = ("passw", "secret", "token", "apikey", "api_key")

_QUOTED = r"""(?:[bBfFrRuU]{1,2})?(?:"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)"""
# What the lexer stops at: comments, names with what separates them from a value, calls with a quoted argument, and
# the text of an XML element before its end tag. Every alternative is possessive, so a text is read in linear time.
_LEX = re.compile(
    r"""(?P<comment>(?<!\S)(?:\#|//)[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?|<!--(?:[^-]|-(?!->))*+)"""
    r"""|(?<![A-Za-z0-9_.])(?<![A-Za-z0-9]-)(?P<q>["']?)(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?P=q)"""
    r"""(?:(?:\x20*+:\x20*+[A-Za-z_][A-Za-z0-9_.\[\]|]*+(?=\x20*+=[^=]))?[\x20\t]*+(?P<sep>:=|=>|=(?![=~>])|:(?![:=])(?!//))[\x20\t]*+|(?P<call>\()\s*+(?=[bBfFrRuU]{0,2}["'`]))"""
    r"""|>(?P<body>[^<>]++)</(?P<tag>[A-Za-z_][A-Za-z0-9_.:\-]*+)\s*+>""",
    re.ASCII,
)
_STRING = re.compile(_QUOTED, re.ASCII)
_INNER = re.compile(r"""[A-Za-z]{0,2}("{3}|'{3}|["'`])""")
_REF = re.compile(r"\$(?:\{(?:env[.:])?([A-Za-z_][A-Za-z0-9_.]*+)\}|([A-Za-z_][A-Za-z0-9_]*+))", re.ASCII)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""", re.ASCII)
_PLUS, _NEXT_STRING = re.compile(r"\s*+\+\s*+"), re.compile(r"""[\x20\t]*+(?:\\?\n[\x20\t]*+)?(?=[bBfFrRuU]{0,2}["'])""")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z_.]*+(?:\+.*)?", re.ASCII)
_BLOCK = re.compile(r"[|>][+\-]?[0-9]?[\x20\t]*+\n")
_LINE = re.compile(r"([\x20\t]*+)([^\n]*+)\n?")
_ARGUMENT, _GAP = re.compile(r"\s*+,\s*+"), re.compile(r"""["']?[\s,]*+["']?""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: What a word of a target's name adds to its score; a literal counts from LEAST_SCORE.
WEIGHTS = {
    "password": 3, "passwd": 3, "pwd": 3, "pass": 2, "passphrase": 3, "secret": 3, "token": 3, "credential": 3, "credentials": 3, "apikey": 3,
    "private": 2, "auth": 2, "bearer": 2, "access": 1, "api": 1, "key": 1, "client": 1, "signing": 2, "encryption": 2, "session": 1, "salt": 2,
    "get": -3, "read": -3, "find": -3, "load": -3, "fetch": -3, "env": -1,
    "count": -3, "length": -3, "limit": -3, "max": -3, "min": -3, "file": -2, "path": -2, "url": -2, "name": -2, "type": -2, "hint": -3, "policy": -3,
}
LEAST_SCORE = 3
#: Texts without any of these have no name that counts.
_TELLING = re.compile("|".join(k for k, v in WEIGHTS.items() if v > 0), re.IGNORECASE)
_DUMMY = re.compile(r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|null|none|true|false|todo|changeme|example|placeholder|undefined|redacted)$")


def name_score(name: str) -> int:
    """Sum of the weights of the words of a name in snake, kebab, dotted or camel case."""
    return sum(WEIGHTS.get(w.lower(), 0) for w in _WORDS.findall(name))


def literal_score(value: str) -> int:
    """What a literal's own shape adds: long, mixed and evenly spread characters; placeholders never count."""
    if len(value) < 6 or _DUMMY.match(value):
        return -100
    counts = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return (entropy >= 3.0) + (kinds >= 3) + (len(value) >= 20 and entropy >= 3.5) - (" " in value) * 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    folded = text.lower()
    if any(c in folded for c in _CUES):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return found


class _Pairs:
    """Names in the order in which they are set, each with the literals and the earlier names that it is made of."""

    def __init__(self) -> None:
        self.stands: dict[str, int] = {}  # the last setting of each name
        self.parts: list[list] = []  # by setting: spans of literals, and numbers of earlier settings
        self.targets: list[int] = []

    def add(self, name: str, parts: list) -> None:
        self.stands[name] = len(self.parts)
        self.parts.append(parts)
        self.targets.append(name_score(name))

    def scored(self) -> dict[tuple[int, int], int]:
        """The best target score of every literal: a setting passes its own and its users' on to what it is made of.
        Settings refer to earlier ones only, so one pass from the last to the first sees every flow."""
        best: dict[tuple[int, int], int] = {}
        for at in range(len(self.parts) - 1, -1, -1):
            target = self.targets[at]
            if target > 0:
                for part in self.parts[at]:
                    if isinstance(part, int):
                        self.targets[part] = max(self.targets[part], target)
                    else:
                        best[part] = max(best.get(part, 0), target)
        return best


def _inside(m: re.Match) -> tuple[int, int]:
    opening = _INNER.match(m[0])
    return m.start() + opening.end(), m.end() - len(opening[1])


def _value(text: str, at: int, known: dict[str, int], spaced: bool) -> tuple[list, int]:
    """What a value starting there is made of, and where it ends: quoted literals, joined by + or by standing side by
    side, names known by now, references ($X, ${X}) and bare words. A call is opaque; its arguments are read later.
    A bare word that could be a name only counts where no blanks surround the separator, as in configuration."""
    parts: list = []
    while True:
        if m := _STRING.match(text, at):
            a, b = _inside(m)
            if a < b:
                parts.append((a, b))
        elif m := _REF.match(text, at):
            name = m[1] or m[2]
            if name in known:
                parts.append(known[name])
        elif m := _BARE.match(text, at):
            if text[m.end() : m.end() + 1] == "(":
                return parts, m.start()
            if m[0] in known:
                parts.append(known[m[0]])
            elif not (spaced and _IDENTIFIER.fullmatch(m[0])):
                parts.append(m.span())
            if text[m.end() : m.end() + 1] == "[":
                return parts[:-1], m.end()
        else:
            return parts, at
        at = m.end()
        if (n := _PLUS.match(text, at)) or (text[at - 1] in "\"'" and (n := _NEXT_STRING.match(text, at))):
            at = n.end()
        else:
            return parts, at


def _block(text: str, key_at: int, at: int) -> tuple[list, int]:
    """A YAML block scalar: the lines after its mark that are blank or indented deeper than its key."""
    begin = text.rfind("\n", 0, key_at) + 1
    indent = key_at - begin if not text[begin:key_at].strip(" -") else 0
    first, last = None, at
    while at < len(text):
        m = _LINE.match(text, at)
        if m[2].strip():
            if len(m[1]) <= indent:
                break
            first = m.start(2) if first is None else first
            last = m.start(2) + len(m[2].rstrip())
        at = m.end()
    return ([] if first is None else [(first, last)]), at


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals whose target name, or the name of a target that they flow into, scores high enough.

    Source, JSON, YAML, environment files and XML are read as name-literal pairs: assignments, keys, named and quoted
    call arguments, attributes, elements, block scalars, and pairs of a name and a value given as two fields. Comments
    are skipped. Constants are propagated: a name set to another name, or to a sum that holds one, passes its score
    back to the literals which that name stands for at that point; a literal keeps the best score.
    """
    if not ("=" in text or ":" in text or "</" in text or "(" in text) or not _TELLING.search(text):
        return []
    pairs, at, field = _Pairs(), 0, (-1, "")
    while m := _LEX.search(text, at):
        at = m.end()
        if m["comment"]:
            continue
        if m["tag"]:
            body = m["body"]
            if body.strip():
                a = m.start("body") + len(body) - len(body.lstrip())
                pairs.add(m["tag"], [(a, a + len(body.strip()))])
            at = m.end("body")
            continue
        name = m["name"]
        if m["call"]:
            first = _STRING.match(text, at)
            if first and (comma := _ARGUMENT.match(text, first.end())) and (second := _STRING.match(text, comma.end())):
                a, b = _inside(first)
                pairs.add(text[a:b], [_inside(second)])
                at = second.end()
            elif first:
                pairs.add(name, [_inside(first)])
                at = first.end()
            continue
        if m["sep"] == ":" and (block := _BLOCK.match(text, at)):
            parts, at = _block(text, m.start(), block.end())
        else:
            parts, at = _value(text, at, pairs.stands, m["sep"] != ":" and text[m.end() - 1 : m.end()] in " \t")
        if name.lower() in ("value", "content", "default") and field[0] >= 0 and _GAP.fullmatch(text, field[0], m.start()):
            pairs.add(field[1], parts)
        pairs.add(name, parts)
        field = (-1, "")
        if name.lower() in ("name", "key", "id") and len(parts) == 1 and not isinstance(parts[0], int):
            field = (parts[0][1], text[parts[0][0] : parts[0][1]])
    return [(a, b, "lexed") for (a, b), target in pairs.scored().items() if target + literal_score(text[a:b]) >= LEAST_SCORE]


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds secrets in every whole text; offsets are code points, ends exclusive.

    Base kinds, each leftmost and non-overlapping: assign (a telling word, : or =, and 6 or more value characters),
    access (AKIA and more, 20 or more characters), hex (24 or more lower-case digits). Kind lexed adds literals of
    source and configuration text by the names they are assigned to, directly or through other names and sums (see
    lexed_spans). A text is read in linear time, however long.

    Columns: id, n_assign, n_access, n_hex, base_sha256 (of the base spans), spans (all, as kind:start:end by start,
    then kind in the order above, comma-joined). A null or empty text has none. Rows are judged alone, so repeated
    rows get equal results. An empty table gives an empty result; extra columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digest, spans = {k: [] for k in KINDS[:3]}, [], []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                for k in counts:
                    counts[k].append(sum(s[2] == k for s in base))
                digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(base + lexed_spans(text)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    fields = [T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)
