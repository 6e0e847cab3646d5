"""Stateful streams against their batch forms, however the input is cut into batches."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import chat
from millrace.streaming import sessions, stateful


def parts(text):
    """Whole text at once, by plain search."""
    out = {"thinking": "", "content": ""}
    while True:
        a = text.find("<think>")
        if a < 0:
            return out["thinking"], out["content"] + text
        out["content"] += text[:a]
        b = text.find("</think>", a)
        out["thinking"] += text[a + 7 : b if b >= 0 else None]
        if b < 0:
            return out["thinking"], out["content"]
        text = text[b + 8 :]


TEXTS = ["<think>ab</think>cd", "a<think>b", "x<thin<think>y</thi</think>z<", "</think>a<think><think>b</think>c</think>", "", "<", "no tags < here <t", "<think></think><think>q</think>"]


@pytest.mark.parametrize("text", TEXTS)
def test_every_split(text):
    """All ways to cut a text into three, and into single characters, give the same parts."""
    cuts = [[text[:i], text[i:j], text[j:]] for i in range(len(text) + 1) for j in range(i, len(text) + 1)] + [list(text) or [""]]
    for chunks in cuts:
        thinking, held, told = False, "", []
        for k, chunk in enumerate(chunks):
            thinking, held, pieces = stateful.think_step(thinking, held, chunk, k == len(chunks) - 1)
            told += pieces
        got = tuple("".join(t for kind, t in told if kind == want) for want in ("thinking", "content"))
        assert got == parts(text) and held == ""


def test_batch_form(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", stateful.think_parts(F.col("t")).alias("p"))
    assert all(tuple(r["p"]) == parts(r["t"]) for r in rows.collect())


def run(spark, tmp_path, name, batches, schema, make):
    """Each batch is a file, read one after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / f"b={i:03}"))
    folder = str(tmp_path / name)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    return stateful.to_end(make(stream), name).collect()


def test_think_stream(spark, tmp_path):
    """State goes over batches, chunks out of their order and repeated ones too."""
    rng = random.Random(1)
    chunks = []
    for c, text in enumerate(TEXTS):
        cuts = sorted(rng.sample(range(len(text) + 1), min(3, len(text))))
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        chunks += [(c, 0, i, p, i == len(pieces) - 1) for i, p in enumerate(pieces)]
    rng.shuffle(chunks)
    chunks += chunks[:5]
    batches = [chunks[i::4] for i in range(4)]
    got = run(spark, tmp_path, "think", batches, "conv_id long, turn long, place int, text string, last boolean", stateful.think_stream)
    for c, text in enumerate(TEXTS):
        own = sorted((r["place"], r["i"], r["kind"], r["text"]) for r in got if r["conv_id"] == c)
        assert tuple("".join(t for *_, kind, t in own if kind == want) for want in ("thinking", "content")) == parts(text)


@pytest.mark.parametrize("ordered", [True, False])
def test_expiry(spark, tmp_path, ordered):
    """Accesses and expiries are those of the batch forms, also where events come late within the bound."""
    rng, start = random.Random(2), datetime(2024, 1, 1)
    events, at = [], start
    for i in range(80):
        at += timedelta(seconds=rng.choice([10, 600, 3000, 7200, 9000]))
        events.append((rng.randrange(3), i, at))
    arriving = events if ordered else sorted(events, key=lambda e: e[2] + timedelta(seconds=rng.randrange(3000)))
    end = max(e[2] for e in events)
    batches = [arriving[i : i + 20] for i in range(0, 80, 20)] + [[(None, None, end + timedelta(hours=1, milliseconds=2))]]
    got = run(spark, tmp_path, f"expiry{ordered}", batches, "user_id long, event_id long, ts timestamp", stateful.expiring)
    log = spark.createDataFrame(events, "user_id long, event_id long, ts timestamp")
    access = {(r["user_id"], r["event_id"], r["idle_seconds"], r["alive"]) for r in got if r["kind"] == "access"}
    assert access == {tuple(r) for r in sessions.touched(log).collect()} and sum(r["kind"] == "access" for r in got) == 80
    expired = sorted((r["user_id"], r["ts"], r["n"]) for r in got if r["kind"] == "expired")
    assert expired == sorted(map(tuple, stateful.expiries(log).collect())) and len(expired) > 5


def test_deltas(spark, tmp_path):
    text = "a growing reply that is written"
    rows = [(c, t, text[: (t + 1) * (c + 3)] if t != 4 else "another") for c in range(3) for t in range(7)] + [(9, 0, None), (9, 1, "x"), (9, 2, "x")]
    batches = [[r for r in rows if r[1] < 2], [r for r in rows if r[1] in (1, 2, 3)], [r for r in rows if r[1] > 3]]
    got = run(spark, tmp_path, "deltas", batches, "conv_id long, turn long, text string", stateful.delta_stream)
    df = spark.createDataFrame([(c, t, x or "") for c, t, x in rows], "conv_id long, turn long, text string")
    assert {(r["conv_id"], r["turn"], r["delta"]) for r in got} == {(r["conv_id"], r["turn"], r["delta"]) for r in chat.deltas(df).collect()} and len(got) == len(rows)
    assert {(r["conv_id"], r["turn"]) for r in got if r["changed"]} == {(r["conv_id"], r["turn"]) for r in chat.changes(df).collect()}


def test_calls(spark, tmp_path):
    rows = [(u, datetime(2024, 1, 1) + timedelta(seconds=i), i, f"call {i * 7 % 5}") for i in range(40) for u in (1, 2)]
    batches = [rows[:30], rows[30:31], rows[31:]]
    schema = "user_id long, ts timestamp, event_id long, call string"
    got = run(spark, tmp_path, "calls", batches, schema, stateful.calls_once)
    assert sorted(map(tuple, got)) == sorted(map(tuple, stateful.first_of_calls(spark.createDataFrame(rows, schema)).collect()))


def test_calls_are_forgotten(spark, tmp_path):
    """Once the watermark is beyond it, a call is told again; calls that come again before are not."""
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    batches = [[(1, at(0), 1, "a"), (1, at(1), 2, "b")], [(1, at(5), 3, "a")], [(1, at(60), 4, "c")], [(1, at(61), 5, "c")], [(1, at(62), 6, "a"), (1, at(62), 7, "c")]]
    got = run(spark, tmp_path, "kept", batches, "user_id long, ts timestamp, event_id long, call string", lambda s: stateful.calls_once(s, keep=1200, late="1 minute"))
    assert sorted((r["event_id"], r["call"]) for r in got) == [(1, "a"), (2, "b"), (4, "c"), (6, "a")]


def test_keys_cost_little(spark, tmp_path):
    """Thousands of replies in one batch: a key's state comes with its rows, without calls to the store for each."""
    rows = [(c, 0, 0, f"<think>{c}</think>x", True) for c in range(4000)]
    start = time.monotonic()
    got = run(spark, tmp_path, "many", [rows], "conv_id long, turn long, place int, text string, last boolean", stateful.think_stream)
    assert {(r["conv_id"], r["text"]) for r in got if r["kind"] == "thinking"} == {(c, str(c)) for c in range(4000)} and len(got) == 8000
    assert time.monotonic() - start < 30


def test_calls_without_user(spark, tmp_path):
    rows = [(None, datetime(2024, 1, 1), 2, "a"), (None, datetime(2024, 1, 1), 1, "a"), (3, datetime(2024, 1, 1), 0, None)]
    got = run(spark, tmp_path, "nobody", [rows], "user_id long, ts timestamp, event_id long, call string", stateful.calls_once)
    assert {tuple(r) for r in got} == {(None, "a", 1), (3, None, 0)}


def test_pieces_read_a_text_once(spark):
    """A text is made and read once, however many pieces it has; characters beyond the basic plane are one."""
    odd = spark.createDataFrame([("ab𝔸\nc",), ("",), (None,)], "t string").select(chat.pieces(F.col("t"), 2).alias("p"))
    assert [r["p"] for r in odd.collect()] == [["ab", "𝔸\n", "c"], [], []]
    start = time.monotonic()
    long = spark.range(1).select(F.explode(chat.pieces(F.repeat(F.concat(F.lit("abcdef"), F.col("id").cast("string")), 300_000), 7)).alias("p"))
    assert long.distinct().count() == 1 and long.count() == 300_000 and time.monotonic() - start < 30
