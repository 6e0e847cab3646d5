"""Structured Streaming forms of the session operators, each with the batch operator that it equals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame) -> DataFrame:
    """Event times of the type that watermarks take."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def sessionized(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a user that end after ``gap`` without events: user_id, session_start, session_end, n. Streams or batches."""
    stream = timed(events).withWatermark("ts", late) if events.isStreaming else events
    return stream.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        "user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total"
    )


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows."""
    stream = timed(events).withWatermark("ts", late) if events.isStreaming else events
    return stream.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


#: Seconds after which uploaded documents and chats expire.
UPLOAD_TIMEOUT, CHAT_TIMEOUT = 7200, 3600


def idle(events: DataFrame, seconds: int = UPLOAD_TIMEOUT, inclusive: bool = False) -> DataFrame:
    """Per user: last event, idle seconds at the log's end by the full difference, and whether the session is expired.

    It is after more than ``seconds``; if ``inclusive``, after as many, too.
    """
    last = events.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    end = events.agg(F.max("ts").alias("now"))
    rows = last.join(F.broadcast(end))
    gap = F.unix_timestamp("now") - F.unix_timestamp("last_ts")
    return rows.select("user_id", "n", "last_ts", gap.alias("idle_seconds"), ((gap >= seconds) if inclusive else (gap > seconds)).alias("expired"))


def touched(events: DataFrame, seconds: int = 7200) -> DataFrame:
    """For each access the idle seconds since the one before, and whether it found its session alive: each access renews it."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = F.unix_timestamp("ts") - F.unix_timestamp(before)
    return events.select("user_id", "event_id", gap.alias("idle_seconds"), F.coalesce(gap <= seconds, F.lit(False)).alias("alive"))


def sequenced(events: DataFrame) -> DataFrame:
    """Numbers the events of each user as they arrive, keeping one counter for each user: user_id, event_id, action_id."""

    def number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        for pdf in frames:
            pdf = pdf.sort_values(["ts", "event_id"])
            yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"], "action_id": [f"ACT_{at + i + 1:04d}" for i in range(len(pdf))]})
            at += len(pdf)
        state.update((at,))

    return events.groupBy("user_id").applyInPandasWithState(
        number, "user_id long, event_id long, action_id string", "n long", "append", GroupStateTimeout.NoTimeout
    )


def numbered(events: DataFrame) -> DataFrame:
    """The batch form of :func:`sequenced`."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("user_id", "event_id", F.format_string("ACT_%04d", F.row_number().over(w)).alias("action_id"))


def first_calls(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (user_id, event_type) call once within the watermark."""
    return timed(calls).withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"])
