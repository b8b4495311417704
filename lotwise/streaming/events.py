"""Product events: validation, scrubbing, sessions and funnels, in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Stages of the funnel, in order, and events that count as another stage as well.
STAGES = ["landing_viewed", "auth_started", "auth_success", "upload_started", "upload_completed", "dashboard_viewed", "meaningful_action"]
ALIASES = {"login_started": "auth_started", "signup_started": "auth_started", "login_success": "auth_success", "signup_success": "auth_success"}
#: How the events of the driver's table stand for stages.
EVENT_STAGES = {"view": "landing_viewed", "signup": "auth_success", "click": "upload_started", "purchase": "meaningful_action"}
GAP = "30 minutes"
#: Keys of metadata that may hold personal data, and values that look like a signed token.
PRIVATE_KEYS = r"(?i)email|password|token|secret|auth_token|user_id|uid|cookie|credential"
SIGNED = r"^ey[A-Za-z0-9_-]{10,}\."


def stage_of(event: Column | str, stages: Sequence[str] = tuple(STAGES)) -> Column:
    """The index of an event's stage, 0 up; null if it is none."""
    name = F.col(event) if isinstance(event, str) else event
    pairs = {s: i for i, s in enumerate(stages)} | {a: stages.index(s) for a, s in (ALIASES | EVENT_STAGES).items() if s in stages}
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))[name]


def errors(df: DataFrame) -> Column:
    """What is wrong with an event record, as an array."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    session, seq = F.col("anonymous_session_id"), F.col("event_sequence").try_cast("double")
    return F.array_compact(
        F.array(
            F.when(blank("event") | (F.length("event") > 64), F.lit("event")),
            F.when(blank("anonymous_session_id") | (F.length(session) > 128), F.lit("anonymous_session_id")),
            F.when(F.try_to_timestamp("timestamp").isNull(), F.lit("timestamp")),
            F.when(seq.isNull() | (seq < 1) | (seq % 1 != 0), F.lit("event_sequence")),
            F.when(F.length("page") > 256, F.lit("page")),
        )
    )


def scrubbed(metadata: Column | str) -> Column:
    """Metadata without private keys and without values that look like an address or a token."""
    return F.map_filter(metadata, lambda k, v: ~k.rlike(PRIVATE_KEYS) & ~F.coalesce(v.contains("@") | v.rlike(SIGNED), F.lit(False)))


def validated(raw: DataFrame) -> DataFrame:
    """Adds errors; valid records are those without. Works on batch and streaming frames."""
    return raw.withColumn("errors", errors(raw)).withColumn("metadata", scrubbed("metadata"))


def url_path(c: Column | str) -> Column:
    host, path = F.try_parse_url(c, F.lit("HOST")), F.try_parse_url(c, F.lit("PATH"))
    return F.when(host.isNull(), "unknown").otherwise(F.concat(F.try_parse_url(c, F.lit("PROTOCOL")), F.lit("://"), host, F.coalesce(path, F.lit(""))))


def url_host(c: Column | str) -> Column:
    return F.coalesce(F.try_parse_url(c, F.lit("HOST")), F.lit("unknown"))


def hash_keys(c: Column | str) -> Column:
    """A location hash with the keys of its query but not their values."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    route, query = F.substring_index(c, "?", 1), F.when(c.contains("?"), F.regexp_replace(c, r"^[^?]*\?", ""))
    keys = F.array_join(F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1)), "&")
    return F.when(c == "", "#/").when(query.isNull() | (query == ""), route).otherwise(F.concat(route, F.lit("?"), keys))


def device(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike("Mobile|Android|iPhone|iPad"), "mobile").when(c.contains("Tablet"), "tablet").otherwise("desktop")


def error_category(c: Column | str) -> Column:
    t = F.lower(F.col(c) if isinstance(c, str) else c)
    any_ = lambda *w: t.rlike("|".join(w))
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "UNKNOWN_ERROR").when(any_("column missing", "required column"), "MISSING_REQUIRED_COLUMNS").when(any_("not a valid", "supported format", "file type", "extension"), "INVALID_FORMAT")
        .when(any_("empty", "no file", "corrupt", "invalid file"), "INVALID_FILE").when(any_("parse", "reading excel", "sheet"), "PARSE_ERROR").otherwise("PROCESSING_ERROR")
    )


def funnel_counts(events: DataFrame, event: str = "event_type") -> DataFrame:
    """Events a stage, empty stages too."""
    found = events.groupBy(stage_of(event).alias("i")).agg(F.count("*").alias("n"))
    spec = events.sparkSession.createDataFrame(list(enumerate(STAGES)), "i int, stage string")
    return spec.join(found, "i", "left").select("stage", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def funnel_by_session(events: DataFrame, session: str = "user_id", event: str = "event_type") -> DataFrame:
    """Each session's furthest stage and its events a stage. Works on batch and streaming frames."""
    s = stage_of(event)
    return events.groupBy(session).agg(F.count("*").alias("events"), F.coalesce(F.max(s), F.lit(-1)).alias("furthest"), *(F.count_if(s == i).alias(f"n_{name}") for i, name in enumerate(STAGES)))


def progressions(events: DataFrame, session: str = "user_id", event: str = "event_type", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Adds seconds since the session's start and since its last event, and whether a new furthest stage is reached."""
    w = W.partitionBy(session).orderBy(ts, tie)
    sec = F.col(ts).cast("timestamp").cast("double")
    before = F.coalesce(F.max(stage_of(event)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    return events.withColumns(
        {"since_start": F.round(sec - F.first(sec).over(w), 3), "since_last": F.round(sec - F.lag(sec).over(w), 3), "is_progression": F.coalesce(stage_of(event) > before, F.lit(False))}
    )


_MICROS = 1_000_000
_NEVER = -(1 << 62)


def progression_stream(events: DataFrame, delay: str, session: str = "user_id", event: str = "event_type", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """What progressions adds, on a stream: session, tie, ts, since_start, since_last, is_progression of every event, once the
    watermark has passed it.

    The state of a session is its start, its last event, its furthest stage, and the events that may still be preceded by
    a late one: those within ``delay`` of the newest. They are put out in order of time and tie, at the latest when the
    session's timeout ends, so a session that falls silent gives its last events too. Events later than the delay are
    dropped by the watermark, which starts at 1970, and so are events without a time. Null sessions are one session, as in
    batch.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.withWatermark(ts, delay).where(F.col(ts).isNotNull()).select(F.when(F.col(session).isNull(), "").otherwise(F.concat(F.lit("="), F.col(session).cast("string"))).alias("session"), F.col(tie).cast("long").alias("tie"), ts, micros.alias("at"), F.coalesce(stage_of(event), F.lit(-1)).cast("long").alias("stage"))
    out = "session string, tie long, at long, first long, last long, is_progression boolean"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, furthest, at, tie, stage = state.get if state.exists else (_NEVER, _NEVER, -1, [], [], [])
        waiting = list(zip(at, tie, stage))
        if not state.hasTimedOut:
            for b in batches:
                waiting += zip(b["at"].tolist(), b["tie"].tolist(), b["stage"].tolist())
        waiting.sort()
        passed, rows = state.getCurrentWatermarkMs() * 1000, []
        for n, (a, t, s) in enumerate(waiting):
            if a > passed:
                waiting = waiting[n:]
                break
            first = a if first == _NEVER else first
            rows.append((key[0], t, a, first, last, s > furthest))
            last, furthest = a, max(furthest, s)
        else:
            waiting = []
        state.update((first, last, furthest, *([w[i] for w in waiting] for i in range(3))))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0], passed) // 1000 + 1)
        yield pd.DataFrame(rows, columns=["session", "tie", "at", "first", "last", "is_progression"])

    kept = "first long, last long, furthest long, at array<long>, tie array<long>, stage array<long>"
    found = rows.groupBy("session").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
    since = lambda c: F.when(F.col(c) != _NEVER, F.round(F.col("at") / _MICROS - F.col(c) / _MICROS, 3))
    named = F.when(F.col("session") != "", F.substring("session", 2, 1 << 30)).cast(events.schema[session].dataType)
    return found.select(named.alias(session), F.col("tie").alias(tie), F.timestamp_micros("at").alias(ts), since("first").alias("since_start"), since("last").alias("since_last"), "is_progression")


def replayed_progressions(events: DataFrame, folder: str, delay: str = "1 hour", **columns: str) -> DataFrame:
    """progression_stream over a table, read as a stream of its files, and its rows when the stream has ended.

    One more event, long after the others, lets the watermark pass them; its own row never comes.
    """
    spark, ts = events.sparkSession, columns.get("ts", "ts")
    events.write.mode("overwrite").parquet(f"{folder}/events/0")
    rows = spark.read.parquet(f"{folder}/events/0")
    last = rows.agg(F.max(ts).alias(ts)).where(F.col(ts).isNotNull()).withColumn(ts, (F.col(ts) + F.expr(f"interval {delay}") + F.expr("interval 1 day")).cast(rows.schema[ts].dataType))
    last = last.withColumn(columns.get("tie", "event_id"), F.lit(0))
    rows.limit(0).unionByName(last, allowMissingColumns=True).coalesce(1).write.mode("overwrite").parquet(f"{folder}/events/1")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{folder}/events")
    found = progression_stream(stream, delay, **columns)
    q = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """Sessions of a user: a gap of 30 minutes ends one. With a watermark the same call serves a stream."""
    e = events.withWatermark(ts, watermark) if watermark else events
    s = e.groupBy(user, F.session_window(ts, GAP).alias("w")).agg(F.count("*").alias("events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return s.select(user, "events", "first_ts", "last_ts")


def without_repeats(events: DataFrame, keys: Sequence[str], ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """Each (session, sequence) once; on a stream within the watermark."""
    if events.isStreaming:
        return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def ingest(raw: DataFrame, good: str, bad: str, checkpoint: str, sinks: Sequence[Callable[[DataFrame], None]] = ()) -> StreamingQuery:
    """Splits a stream into valid events and a quarantine, both Parquet; ``sinks`` get every batch of valid events."""
    def each(batch: DataFrame, number: int) -> None:
        marked = validated(batch).withColumn("batch", F.lit(number))
        valid = marked.where(F.size("errors") == 0).drop("errors")
        valid.write.mode("overwrite").parquet(f"{good}/batch={number}")  # a batch that runs again replaces itself
        marked.where(F.size("errors") > 0).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        for sink in sinks:
            sink(valid)
    return raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_incrementally(spark: SparkSession, landing: str, schema: str, pipeline: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Runs a batch pipeline over every new file of a landing folder of Parquet grids, each once."""
    return spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(lambda batch, _: pipeline(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
