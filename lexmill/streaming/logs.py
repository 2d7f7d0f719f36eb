"""Streaming forms of the log dashboards: an extension; the batch operators are the reference.

Each takes a streaming (or batch) DataFrame of events and gives another; the caller chooses the
sink. State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_usage(events: DataFrame, ts: str, by: str, value: str, window: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Calls and total by window and group; a window closes when the watermark passes it."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    out = events.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("calls"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "calls", "total")


def windowed_hits(events: DataFrame, ts: str, hit: Column, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows, hits and hit rate by window."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return out.select(F.col("window.start").alias("start"), "n", "hits", F.round(F.col("hits") / F.col("n") * 100, 1).alias("hit_rate"))


def sessions(events: DataFrame, ts: str, who: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a longer gap."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), who).agg(F.count("*").alias("n"))
    return out.select(who, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_reports(events: DataFrame, ts: str, key: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def answered_within(questions: DataFrame, answers: DataFrame, session: str, ts: str, most: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Questions with the answers of their session that follow within a time: a stream-stream interval join."""
    q = questions.withWatermark(ts, late).select(F.col(session).alias("session"), F.col(ts).alias("asked"))
    a = answers.withWatermark(ts, late).select(F.col(session).alias("_session"), F.col(ts).alias("answered"))
    met = (F.col("session") == F.col("_session")) & (F.col("answered") > F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"INTERVAL {most}"))
    return q.join(a, met).drop("_session")


def recent_requests(events: DataFrame, ts: str, by: str, window: str = "60 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Requests of each sliding window and group: what a limit of so many a minute looks at."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, window, slide), by).agg(F.count("*").alias("requests"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "requests")


def cache_hits(events: DataFrame, ts: str, key: str, keep: str) -> DataFrame:
    """Batch form: each event with hit, whether its key was used within ``keep`` before it."""
    from pyspark.sql import Window

    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts))
    return events.withColumn("hit", F.coalesce(F.col(ts) <= before + F.expr(f"INTERVAL {keep}"), F.lit(False)))


def cache_hits_stream(events: DataFrame, ts: str, key: str, keep_seconds: int, late: str = "1 minute") -> DataFrame:
    """Streaming form: key, ts and hit of each event; a key's state ends ``keep_seconds`` after its last event."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(name, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        (last,) = state.get if state.exists else (None,)
        for rows in batches:
            rows = rows.sort_values(ts)
            hits = []
            for at in rows[ts]:
                at_ms = int(pd.Timestamp(at).timestamp() * 1000)
                hits.append(last is not None and at_ms - last <= keep_seconds * 1000)
                last = at_ms if last is None else max(last, at_ms)
            yield pd.DataFrame({key: rows[key], ts: rows[ts], "hit": hits})
        state.update((last,))
        state.setTimeoutTimestamp(max(last + keep_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    kind = events.schema[key].dataType.simpleString()
    slim = events.select(key, ts).withWatermark(ts, late)
    return slim.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ts} timestamp, hit boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)
