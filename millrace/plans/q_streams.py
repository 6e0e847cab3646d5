"""Streams that are run to their end, as tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import chat as H
from millrace.plans import views as V
from millrace.plans.q_chat import _SNAP, _snapshots, _tagged
from millrace.plans.q_chat import ORACLE as CHAT
from millrace.sources import tables as S
from millrace.streaming import stateful as T

QUERIES: dict = {}
ORACLE: dict = {}


def add(name, sql):
    def deco(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return deco


C = F.col


def _stream(df, name):
    """A table's rows as a stream of files in the shared folder."""
    path = S.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@add("think_stream", CHAT["think_split"])
def _(spark, sf):
    """Replies in chunks of seven characters, parsed as they arrive, the last chunks first."""
    pieces = H.pieces(C("tagged"), 7)
    rows = _tagged(spark, sf).select("conv_id", "turn", F.size(pieces).alias("n"), F.posexplode(pieces).alias("place", "text"))
    rows = rows.select("conv_id", "turn", "place", "text", (C("place") == C("n") - 1).alias("last")).repartition(4, "place")
    told = T.to_end(T.think_stream(_stream(rows, "chunks")), "think")
    of = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(C("kind") == kind, F.struct("place", "i", "text")))), lambda r: r["text"]), "")
    return told.groupBy("conv_id", "turn").agg(of("thinking").alias("thinking"), of("content").alias("content"))


_EXPIRIES = """WITH l AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), b AS (SELECT *, s - lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM l),
  k AS (SELECT *, sum(CASE WHEN gap <= 7200 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM b), a AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS n FROM k),
  g AS (SELECT user_id, k, max(s) AS s, count(*) AS n FROM k GROUP BY ALL), x AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY k), (SELECT max(s) FROM l)) - s AS idle FROM g)"""


@add("expiry_stream", f"{_EXPIRIES} SELECT 'access' AS kind, user_id, event_id, s AS at, gap AS idle_seconds, coalesce(gap <= 7200, false) AS alive, n FROM a UNION ALL SELECT 'expired', user_id, NULL, s, NULL, NULL, n FROM x WHERE idle > 7200")
def _(spark, sf):
    """Every event is an access; a mark after the last one moves time on to it."""
    events = V.table(spark, sf, "events").select("user_id", "event_id", C("ts").cast("timestamp").alias("ts"))
    end = events.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("event_id"), (C("ts") + F.expr("INTERVAL 1 HOUR 0.002 SECOND")).alias("ts"))
    told = T.to_end(T.expiring(_stream(events.unionByName(end), "accesses")), "expiries")
    return told.select("kind", "user_id", "event_id", F.unix_timestamp("ts").alias("at"), "idle_seconds", "alive", "n")


@add("session_expiries", f"{_EXPIRIES} SELECT user_id, s AS at, n FROM x WHERE idle > 7200")
def _(spark, sf):
    return T.expiries(V.table(spark, sf, "events")).select("user_id", F.unix_timestamp(C("ts").cast("timestamp")).alias("at"), "n")


@add("snapshot_stream", f"WITH s AS ({_SNAP}), x AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM s) SELECT conv_id, turn, CASE WHEN starts_with(text, coalesce(b, '')) THEN substring(text, length(coalesce(b, '')) + 1) ELSE text END AS delta, text IS DISTINCT FROM b AS changed FROM x")
def _(spark, sf):
    return T.to_end(T.delta_stream(_stream(_snapshots(spark, sf), "snapshots")), "deltas").drop("text")


@add("calls_once", "SELECT user_id, event_type AS call, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def _(spark, sf):
    calls = V.table(spark, sf, "events").select("user_id", C("ts").cast("timestamp").alias("ts"), "event_id", C("event_type").alias("call"))
    return T.to_end(T.calls_once(_stream(calls, "calls")), "calls")


@add("first_calls", "SELECT user_id, event_type AS call, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def _(spark, sf):
    return T.first_of_calls(V.table(spark, sf, "events").select("user_id", "ts", "event_id", C("event_type").alias("call")))
