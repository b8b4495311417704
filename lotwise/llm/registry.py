"""The registered queries of the corpus operators and, where SQL can express one, its SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lotwise.llm import conversations, decontaminate, langid, line_dedup, mixing, quality, quotes, ranked_search, repeats, secrets, shard, simhash, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over conversations whose messages quote earlier ones: the given table has no quotes, so they are made here.

    By turn mod 4: 1 quotes the message before, 2 that and, nested, the one before it, 3 only the latter, 0 none."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.coalesce(F.min("text"), F.lit("")).alias("text"))
    before = lambda n, c: rows.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(c))
    rows = rows.join(before(1, "one"), ["conv_id", "turn"], "left").join(before(2, "two"), ["conv_id", "turn"], "left")
    def quoted(c: str, mark: str) -> Column:
        return F.concat(F.lit(mark), F.replace(c, F.lit("\n"), F.lit(f"\n{mark}")), F.lit("\n"))
    head, kind = F.lit("On Monday they wrote:\n"), F.col("turn") % 4
    marked = F.when(kind == 1, F.concat(head, quoted("one", "> "))).when(kind == 2, F.concat(head, quoted("one", "> "), quoted("two", ">> "))).when(kind == 3, quoted("two", "> "))
    return quotes.link_quotes(rows.select("conv_id", "turn", "role", F.concat(F.coalesce(marked, F.lit("")), "text").alias("text")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), width=13)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, shingle=4)


#: The rank file of a public byte-level vocabulary, read on the driver; set LOTWISE_VOCABULARY to use another.
VOCABULARY = os.environ.get("LOTWISE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(table(spark, sf_dir, "documents"), token_counts.vocabulary(VOCABULARY))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), least_chars=20, least_docs=3)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_quotation_linking,
        quoted_replies,
        op3_sharding,
        op4_substring_dedup,
        op5_simhash,
        op6_token_counts,
        op7_mixing,
        op8_language_id,
        op9_decontamination,
        op10_secret_scan,
        op11_conversation_repair,
        op12_ranked_search,
        op13_line_dedup,
    )
}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_TEST_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
k AS (SELECT r, doc_id, p, array_to_string(w[p:p + 12], ' ') AS t FROM s),
f AS (SELECT t, min(doc_id) AS first FROM k GROUP BY 1),
h AS (SELECT k.r, k.p FROM k JOIN f USING (t) WHERE k.doc_id > f.first),
g AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS q FROM h),
x AS (SELECT r, list(q) AS gone FROM g GROUP BY 1),
m AS (SELECT d.doc_id, d.w, coalesce(x.gone, []) AS gone FROM d LEFT JOIN x USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda v, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256 FROM m"""

OP9_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TEST_WORDS} AS w FROM benchmark),
i AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS t FROM i),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TEST_WORDS} AS w FROM documents),
s AS (SELECT d.r, d.w, l.n, unnest(range(1, len(d.w) - l.n + 2)) AS p FROM d, (SELECT DISTINCT n FROM v) l WHERE len(d.w) >= l.n),
h AS (SELECT s.r, s.p, s.n, v.item FROM s JOIN v ON v.n = s.n AND v.t = array_to_string(s.w[s.p:s.p + s.n - 1], ' ')),
g AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1),
t AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(g.n_hit, 0) AS n_hit, CAST(coalesce(len(t.items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(t.items, ','), '')) AS items_sha256, coalesce(g.n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN g USING (r) LEFT JOIN t USING (r)"""

_TERMS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(ts)) AS n_terms FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t),
m AS (SELECT r, doc_id, 50 + (50 * len(ts) * n_docs) // n_terms AS m FROM d, c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS score FROM q JOIN w USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 50"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (k.doc_id < c.stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL OR k.doc_id >= c.stays), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY k.r, k.doc_id"""

_NORM = r"trim(lower(regexp_replace({}, '[\s\x01]+', ' ', 'g')))"
_MARKS = r"^[\x20\t]*(?:>[\x20\t]*)+"
_OP2_SQL = rf"""
m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) AS ls FROM conversations),
l0 AS (SELECT r, conv_id, turn, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x FROM m),
l AS (SELECT r, conv_id, turn, i, length(regexp_replace(regexp_extract(x, '{_MARKS}'), '[^>]', '', 'g')) AS level, regexp_replace(x, '{_MARKS}', '') AS content FROM l0),
n AS (SELECT *, {_NORM.format('content')} AS norm, lag(level) OVER w AS last_level, lag({_NORM.format('content')}) OVER w AS last_norm, lead(level) OVER w AS next_level FROM l WINDOW w AS (PARTITION BY r ORDER BY i)),
p0 AS (SELECT *, sum(CASE WHEN last_level IS NULL OR last_level <> level OR last_norm = '' OR norm = '' THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM n),
p AS (SELECT r, conv_id, turn, level, string_agg(norm, ' ' ORDER BY i) AS u FROM p0 WHERE norm <> '' GROUP BY r, conv_id, turn, level, run),
u AS (SELECT DISTINCT r, conv_id, turn, level, u FROM (SELECT r, conv_id, turn, level, u FROM p UNION ALL SELECT r, conv_id, turn, level, norm FROM n UNION ALL SELECT r, conv_id, turn, -1, {_NORM.format("coalesce(string_agg(content, ' ' ORDER BY i), '')")} FROM n WHERE level = 0 AND NOT (regexp_matches(content, '{quotes.ATTRIBUTION}') AND coalesce(next_level, 0) > 0) GROUP BY r, conv_id, turn) WHERE u <> ''),
o AS (SELECT conv_id, u, min(turn) AS anywhere, min(turn) FILTER (level < 0) AS whole FROM u WHERE level <= 0 GROUP BY ALL),
votes AS (SELECT u.conv_id, u.turn, level, CASE WHEN whole < u.turn THEN whole ELSE anywhere END AS origin, sum(length(u.u)) AS chars FROM u JOIN o USING (conv_id, u) WHERE level > 0 AND origin < u.turn GROUP BY ALL),
links AS (SELECT conv_id, turn, origin AS reply_to FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, chars DESC, origin DESC) = 1),
up AS (SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM links UNION ALL SELECT up.conv_id, up.turn, k.reply_to, up.depth + 1 FROM up JOIN links k ON k.conv_id = up.conv_id AND k.turn = up.thread),
tree AS (SELECT conv_id, reply_to AS turn, [reply_to] AS path FROM links WHERE (conv_id, reply_to) NOT IN (SELECT (conv_id, turn) FROM links) GROUP BY ALL UNION ALL SELECT k.conv_id, k.turn, list_append(tree.path, k.turn) FROM tree JOIN links k ON k.conv_id = tree.conv_id AND k.reply_to = tree.turn),
placed AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, path[1] ORDER BY path) - 1 AS place FROM tree),
root AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM up GROUP BY ALL),
q AS (SELECT r, max(level) AS quote_level, count(*) FILTER (level > 0) AS n_quoted, regexp_replace(coalesce(string_agg(content, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (regexp_matches(content, '{quotes.ATTRIBUTION}') AND coalesce(next_level, 0) > 0)), ''), '^\n+|\n+$', '', 'g') AS body FROM n GROUP BY r)
SELECT m.conv_id, m.turn, m.role, k.reply_to, coalesce(root.thread, m.turn) AS thread, CAST(coalesce(root.depth, 0) AS BIGINT) AS depth, coalesce(placed.place, 0) AS place, CAST(q.quote_level AS INT) AS quote_level, CAST(q.n_quoted AS INT) AS n_quoted, q.body
FROM m JOIN q USING (r) LEFT JOIN links k ON k.conv_id = m.conv_id AND k.turn = m.turn LEFT JOIN root ON root.conv_id = m.conv_id AND root.turn = m.turn LEFT JOIN placed ON placed.conv_id = m.conv_id AND placed.turn = m.turn"""
OP2_SQL = "WITH RECURSIVE " + _OP2_SQL
QUOTED_SQL = """WITH RECURSIVE plain AS (SELECT conv_id, turn, min(role) AS role, coalesce(min(text), '') AS text FROM conversations GROUP BY ALL),
both_ AS (SELECT p.*, a.text AS one, b.text AS two FROM plain p LEFT JOIN plain a ON a.conv_id = p.conv_id AND a.turn = p.turn - 1 LEFT JOIN plain b ON b.conv_id = p.conv_id AND b.turn = p.turn - 2),
q1 AS (SELECT *, '> ' || replace(one, chr(10), chr(10) || '> ') || chr(10) AS first, '>> ' || replace(two, chr(10), chr(10) || '>> ') || chr(10) AS nested, '> ' || replace(two, chr(10), chr(10) || '> ') || chr(10) AS second FROM both_),
quoted AS (SELECT conv_id, turn, role, coalesce(CASE turn % 4 WHEN 1 THEN 'On Monday they wrote:' || chr(10) || first WHEN 2 THEN 'On Monday they wrote:' || chr(10) || first || nested WHEN 3 THEN second END, '') || text AS text FROM q1),
""" + _OP2_SQL.replace("FROM conversations)", "FROM quoted)")

#: The other operators hash, iterate, tokenise or learn in ways that SQL does not have; tests compare them with brute force.
ORACLES: dict[str, str] = {"op2_quotation_linking": OP2_SQL, "quoted_replies": QUOTED_SQL, "op4_substring_dedup": OP4_SQL, "op9_decontamination": OP9_SQL, "op12_ranked_search": OP12_SQL, "op13_line_dedup": OP13_SQL}
