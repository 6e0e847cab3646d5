"""Stateful operators on streams: replies split at think tags, sessions that expire, deltas of snapshots, calls said once.

Each keeps a small state for its key and equals a batch operator, named beside it, however a stream is cut into batches.
A key's state comes and goes with its rows, many keys at a time, so a key costs no calls back to the store.
They need the RocksDB state store, which :func:`to_end` and :func:`rocksdb` set for the queries that they start.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.sources.tables import scratch
from millrace.streaming.sessions import UPLOAD_TIMEOUT, timed

OPEN, CLOSE = "<think>", "</think>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streaming queries that start within keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def to_end(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives until its source is read to the end, as a table in the shared folder."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    with rocksdb(spark):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# --- think tags ------------------------------------------------------------------------------------------------------
def think_step(thinking: bool, held: str, chunk: str, last: bool) -> tuple[bool, str, list[tuple[str, str]]]:
    """One chunk of a reply: the mode and the text that may begin a tag afterwards, and the pieces (kind, text) told."""
    text, told = held + chunk, []
    while True:
        tag = CLOSE if thinking else OPEN
        at = text.find(tag)
        if at < 0:
            break
        told.append(("thinking" if thinking else "content", text[:at]))
        text, thinking = text[at + len(tag) :], not thinking
    keep = 0 if last else next((n for n in range(min(len(tag) - 1, len(text)), 0, -1) if tag.startswith(text[-n:])), 0)
    told.append(("thinking" if thinking else "content", text[: len(text) - keep]))
    return thinking, text[len(text) - keep :], [(k, t) for k, t in told if t]


def think_parts(text: Column) -> Column:
    """struct(thinking, content) of a whole reply: what stands between think tags, to the end if one stays open, and the rest."""
    block = r"(?s)<think>(.*?)(?:</think>|\z)"
    return F.struct(F.array_join(F.regexp_extract_all(text, F.lit(block), F.lit(1)), "").alias("thinking"), F.regexp_replace(text, block, "").alias("content"))


_PIECES = ["conv_id", "turn", "place", "i", "kind", "text"]
#: The mode, the text that may begin a tag, the next chunk's number, and chunks that came before their turn.
_AT = "thinking boolean, held string, next int, places array<int>, texts array<string>, lasts array<boolean>"


def _think(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    thinking, held, place, *early = state.get if state.exists else (False, "", 0, [], [], [])
    here = {}
    for pdf in rows:
        here |= {int(p): (t or "", bool(z)) for p, t, z in zip(pdf["place"], pdf["text"], pdf["last"]) if p >= place}
    here |= {p: (t, z) for p, t, z in zip(*early)}
    told = []
    while place in here:
        text, last = here.pop(place)
        thinking, held, pieces = think_step(thinking, held, text, last)
        told += [(*key, place, i, kind, piece) for i, (kind, piece) in enumerate(pieces)]
        place += 1
    state.update((thinking, held, place, list(here), [t for t, _ in here.values()], [z for _, z in here.values()]))
    if told:
        yield pd.DataFrame(told, columns=_PIECES)


def think_stream(chunks: DataFrame) -> DataFrame:
    """Pieces of thinking and content as chunks of replies arrive: conv_id, turn, place, i, kind, text.

    ``chunks``: conv_id, turn, place (from 0), text and last, true for a reply's last chunk. An unfinished tag waits for the
    next chunk; so do chunks that arrive before their turn. A chunk that comes again is not told again. The pieces
    of a reply, in order, are its :func:`think_parts`.
    """
    schema = "conv_id long, turn long, place int, i int, kind string, text string"
    return chunks.groupBy("conv_id", "turn").applyInPandasWithState(_think, schema, _AT, "Append", GroupStateTimeout.NoTimeout)


# --- expiry ----------------------------------------------------------------------------------------------------------
#: Stands for a null user, as keys of no value come as NaN.
_NOBODY = -(2**63)


def _wake(state: GroupState, due: list[int], now: int) -> None:
    """Has the key seen again once the watermark has reached the first of ``due``, in milliseconds."""
    if due:
        state.setTimeoutTimestamp(max(min(due) - 1, now, 1))


#: The last access, in microseconds, the accesses since the session began, whether it has expired, and accesses not yet final.
_KNOWN = "last long, n long, expired boolean, waiting array<long>, events array<long>"


def _expiry(seconds: int):
    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """What is final at the watermark, in order of event time."""
        user, now = int(key[0]), state.getCurrentWatermarkMs()
        last, n, expired, *held = state.get if state.exists else (None, 0, False, [], [])
        waiting = set(zip(*held))
        for pdf in rows:
            pdf = pdf[pdf["event_id"].notna()]
            waiting |= {(int(t), int(e)) for t, e in zip(pdf["us"], pdf["event_id"])}
        told, left = [], []
        for ts, event in sorted(waiting):
            if ts > now * 1000:
                left.append((ts, event))
                continue
            gap = None if last is None else ts // 1_000_000 - last // 1_000_000
            if gap is not None and gap > seconds and not expired:
                told.append((user, "expired", None, last, None, None, n))
            alive = gap is not None and gap <= seconds
            n, last, expired = n + 1 if alive else 1, ts, False
            told.append((user, "access", event, ts, gap, alive, n))
        if last is not None and not expired and now // 1000 - last // 1_000_000 > seconds:
            told.append((user, "expired", None, last, None, None, n))
            expired = True
        state.update((last, n, expired, [t for t, _ in left], [e for _, e in left]))
        due = [-(-left[0][0] // 1000)] if left else []
        if last is not None and not expired:
            due.append((last // 1_000_000 + seconds + 1) * 1000)
        _wake(state, due, now)
        if told:
            out = pd.DataFrame(told, columns=["user_id", "kind", "event_id", "us", "idle_seconds", "alive", "n"])
            yield out.astype({"event_id": "Int64", "idle_seconds": "Int64", "alive": "boolean"})

    return step


def expiring(events: DataFrame, seconds: int = UPLOAD_TIMEOUT, late: str = "1 hour") -> DataFrame:
    """Accesses of sessions, each of which renews its session, and expiries, as the watermark passes them.

    ``events``: user_id, event_id, ts. A row ``access`` has the idle seconds since the one before, whether it found its
    session alive, and the session's accesses so far; a row ``expired`` has the last access and their number. Events
    may come in any order within ``late``; each is told once the watermark has passed it, so the rows are those of
    :func:`millrace.streaming.sessions.touched` and :func:`expiries` over the same log. A row without event_id is no access but moves time on.
    """
    stream = timed(events.select(F.coalesce("user_id", F.lit(_NOBODY)).alias("user_id"), "event_id", "ts")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    schema = "user_id long, kind string, event_id long, us long, idle_seconds long, alive boolean, n long"
    told = stream.groupBy("user_id").applyInPandasWithState(_expiry(seconds), schema, _KNOWN, "Append", GroupStateTimeout.EventTimeTimeout)
    user = F.when(F.col("user_id") != _NOBODY, F.col("user_id")).alias("user_id")
    return told.select(user, "kind", "event_id", F.timestamp_micros("us").alias("ts"), "idle_seconds", "alive", "n")


def expiries(events: DataFrame, seconds: int = UPLOAD_TIMEOUT) -> DataFrame:
    """user_id, ts, n: the last access of each session that has expired by the log's end, and its accesses."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    rows = events.select("user_id", "event_id", "ts", F.sum(F.when(gap <= seconds, 0).otherwise(1)).over(w).alias("k"))
    rows = rows.groupBy("user_id", "k").agg(F.max("ts").alias("ts"), F.count("*").alias("n"))
    end = F.broadcast(events.agg(F.max("ts").alias("__now")))
    later = F.coalesce(F.lead("ts").over(Window.partitionBy("user_id").orderBy("k")), F.col("__now"))
    return rows.join(end).withColumn("__gap", F.unix_timestamp(later) - F.unix_timestamp("ts")).where(F.col("__gap") > seconds).select("user_id", "ts", "n")


# --- snapshots and calls ---------------------------------------------------------------------------------------------
def _delta(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the last snapshot, and its turn."""
    before, at = state.get if state.exists else ("", None)
    told = []
    for turn, text in sorted((int(n), t or "") for pdf in rows for n, t in zip(pdf["turn"], pdf["text"])):
        if at is not None and turn <= at:
            continue  # told already
        told.append((*key, turn, text, text[len(before) :] if text.startswith(before) else text, at is None or text != before))
        before, at = text, turn
    state.update((before, at))
    if told:
        yield pd.DataFrame(told, columns=["conv_id", "turn", "text", "delta", "changed"])


def delta_stream(snapshots: DataFrame) -> DataFrame:
    """conv_id, turn, text, delta, changed: what each growing snapshot adds to the last one, as it arrives.

    Snapshots (conv_id, turn, text) come in the order of turns from batch to batch; one that comes again is not told
    again. Equals :func:`millrace.operators.chat.deltas`; ``changed`` marks the rows of :func:`millrace.operators.chat.changes`.
    """
    schema = "conv_id long, turn long, text string, delta string, changed boolean"
    return snapshots.groupBy("conv_id").applyInPandasWithState(_delta, schema, "text string, turn long", "Append", GroupStateTimeout.NoTimeout)


def _calls(keep: int | None):
    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """State: the calls that were told, and when, in seconds; each until the watermark is ``keep`` seconds beyond."""
        user = int(key[0])
        seen = dict(zip(*state.get)) if state.exists else {}
        told = []
        for pdf in rows:
            pdf = pdf[~pdf["call"].isin(list(seen))]  # most rows are calls told before
            first = pdf.sort_values(["us", "event_id"]).drop_duplicates("call")
            told += [(int(t), int(e), None if pd.isna(c) else c) for t, e, c in zip(first["us"], first["event_id"], first["call"])]
        fresh = []
        for ts, event, call in sorted(told, key=lambda r: r[:2]):
            if call not in seen:
                seen[call] = ts // 1_000_000
                fresh.append((user, call, event))
        if keep is not None:
            now = state.getCurrentWatermarkMs()
            seen = {c: at for c, at in seen.items() if at + keep >= now // 1000}
            _wake(state, [(at + keep + 1) * 1000 for at in seen.values()], now)
        state.update((list(seen), list(seen.values())))
        if fresh:
            yield pd.DataFrame(fresh, columns=["user_id", "call", "event_id"])

    return step


def calls_once(calls: DataFrame, keep: int | None = None, late: str = "1 hour") -> DataFrame:
    """user_id, call, event_id: each call (user_id, ts, event_id, call) of a user the first time it is seen.

    With ``keep`` a call is forgotten once the watermark is so many seconds beyond it, and may be told again. Without,
    equals :func:`first_of_calls` where calls arrive in order.
    """
    if keep is not None:
        calls = timed(calls).withWatermark("ts", late)
    calls = calls.select(F.coalesce("user_id", F.lit(_NOBODY)).alias("user_id"), "ts", F.unix_micros("ts").alias("us"), "event_id", "call")
    timeout = GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.EventTimeTimeout
    told = calls.groupBy("user_id").applyInPandasWithState(_calls(keep), "user_id long, call string, event_id long", "calls array<string>, at array<long>", "Append", timeout)
    return told.withColumn("user_id", F.when(F.col("user_id") != _NOBODY, F.col("user_id")))


def first_of_calls(calls: DataFrame) -> DataFrame:
    """The batch form of :func:`calls_once`."""
    return calls.groupBy("user_id", "call").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
