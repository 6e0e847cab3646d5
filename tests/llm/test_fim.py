"""Fill-in-the-middle samples against plain Python and SQL."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import fim


def brute(doc_id, text, units=r"(?s).", seed=1, plain_percent=10, spm_percent=20):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    parts = re.findall(units, text)
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(x in text for x in fim.MARKERS) or h[2] % 100 >= 100 - plain_percent:
        return n, "plain", None, None, None, text
    if h[3] % 100 < spm_percent:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(11)
    letters = ["a", "b", " ", "\n", "\u0001", "\u0002", "e", "d", "<", ">", "P", "S", "M", "é", "文", "\U0001f600", "é", "$", "\\", "\x00", "\r"]
    out = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))) for i in range(600)]
    out += [(600, None), (601, ""), (602, "\u0002"), (603, "\u0001"), (604, "\u0002e\u0002d\u0001"), (605, "x<P>y"), (606, "a<" * 9), (None, "no id"), (607, "long 文 " * 40_000)]
    return out + [(608, "repeated row")] * 3 + [(608, "another text")]


@pytest.mark.parametrize("units, pattern", [("chars", r"(?s)."), ("words", r"\S+[ \t\n\x0b\f\r]*|[ \t\n\x0b\f\r]+"), ("lines", r"[^\n]*\n|[^\n]+")])
def test_against_plain_python(spark, units, pattern):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int")
    got = fim.transform(df, units=units, seed=3, plain_percent=15, spm_percent=40).collect()
    made = sorted(((r["doc_id"], r["n"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"], r["restored"]) for r in got), key=str)
    spaced = [(i, re.sub(r"[\x1c-\x1f\x85 ]", "", t) if t else t) for i, t in rows]
    assert spaced == rows
    want = sorted(((i, *brute(i, t, pattern, 3, 15, 40), t or "") for i, t in rows), key=str)
    assert made == want
    assert {r[2] for r in made} == {"plain", "psm", "spm"}


def test_digests(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((tuple(r) for r in fim.digests(fim.transform(df)).collect()), key=str)
    want = []
    for i, t in texts():
        n, form, p, m, _, out = brute(i, t)
        want.append((i, n, form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(t or "")))
    assert got == sorted(want, key=str)


def test_shares_and_odd_rows(spark, odd, none):
    got = fim.transform(odd, plain_percent=0, spm_percent=100).collect()
    assert len(got) == odd.count() and {r["form"] for r in got} == {"plain", "spm"}
    assert all(r["restored"] == r["output"] for r in got if r["form"] == "plain")
    assert fim.transform(none).columns == ["doc_id", "n", "form", "prefix", "middle", "suffix", "output", "restored"] and not fim.transform(none).collect()
    assert {r["form"] for r in fim.transform(odd, plain_percent=100).collect()} == {"plain"}


def test_no_python_in_the_plan(spark, odd):
    plan = fim.digests(fim.transform(odd))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("markers", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c"), ("<P>", "x<P>y", "z")])
def test_markers_that_mix(spark, odd, markers):
    with pytest.raises(ValueError):
        fim.transform(odd, markers=markers)


def test_other_markers(spark):
    marks = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    df = spark.createDataFrame([(i, f"def f{i}(x):\n    return x + {i}\n") for i in range(200)], "doc_id long, text string")
    got = fim.transform(df, markers=marks, units="lines")
    assert got.where(F.col("restored").isNull()).isEmpty()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert all(r["restored"] == texts[r["doc_id"]] for r in got.collect())
