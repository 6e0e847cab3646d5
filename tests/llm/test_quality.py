"""Quality votes against plain Python, and their accuracy on rows held out."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality, queries

SF = "/root/testdata/sf0.1"


def brute_shapes(text):
    """Term counts, one character of UTF-8 at a time."""
    def shape(b):
        c = chr(b)
        if b >= 128:
            return 4
        if c.isalnum():
            return 1 if c.islower() else 2 if c.isupper() else 3
        return 5 if c in " \t" else 6 if c in "\n\r" else 8 + [x for x in range(33, 127) if not chr(x).isalnum()].index(b) if 33 <= b < 127 else 7

    out = np.zeros(quality.TERMS)
    if not text:
        return out
    s = [0, 0]
    for b in text.encode():
        if s[-1] != shape(b):
            s.append(shape(b))
    s += [0, 0]
    for a, b, c in zip(s, s[1:], s[2:]):
        out[quality._TERM[a << 12 | b << 6 | c]] += 1
    return out


def brute_measures(text):
    ws = text.encode().lower().split()
    n = len(ws)
    if not n:
        return [0.0] * 5
    counts = Counter(ws)
    again = lambda k: sum(a == b for a, b in zip(ws, ws[k:])) / (n - k) if n > k else 0.0
    return [len(counts) / n**0.75, max(counts.values()) / n if n >= 20 else 0.0, again(1), again(2), min(1.0, n / 100)]


def brute_score(model, text):
    t = np.log1p(brute_shapes(text)) * model.weight
    t = t / max(np.linalg.norm(t), 1e-9)
    z = np.concatenate([t @ model.axes, 0.3 * np.array(brute_measures(text))])
    z = z / max(np.linalg.norm(z), 1e-9)
    near = sorted(((max(0.0, float(z @ v)), y) for v, y in zip(model.vectors, model.labels)), reverse=True)
    level = near[min(model.neighbours, len(near)) - 1][0]
    votes = [(c**8, y) for c, y in near if c >= level - 1e-5]
    total = sum(w for w, _ in votes)
    return sum(w * y for w, y in votes) / total if total > 1e-12 else model.prior


def corpus():
    rng = random.Random(8)
    good = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(3, 80))).capitalize() + ".\n" for _ in range(60)]
    bad = [g.upper().replace(" ", "!! ") for g in good[:15]] + ["spam " * k for k in range(5, 20)] + [" | ".join(g.split()) for g in good[20:30]]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(100 + i, t, 0) for i, t in enumerate(bad)]
    return rows + [(200, "", 1), (201, None, 0), (202, "x", 1), (203, "1234 " * 3000, 0)]


def test_against_plain_python(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, y, 7) for i, t, y in rows], "doc_id long, text string, label int, score int")
    model = quality.fit(df.select("label", F.coalesce("text", F.lit("")).alias("text")), neighbours=5, axes=16)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert got[i] == pytest.approx(brute_score(model, t or ""), abs=2e-2)
    assert got[200] == got[201] == model.prior
    again = {r["doc_id"]: r["score"] for r in quality.score(df.repartition(7), model).collect()}
    assert again == pytest.approx(got)


def test_features():
    for t in ["", " ", "Aa", "Hello, World!! 123\n\tÜber | x", "\x00\x1f~", "a" * 5000]:
        counts, measures = quality.counted([b"other words", t.encode(), b""])
        assert counts[1].tolist() == brute_shapes(t).tolist()
        assert measures[1].tolist() == pytest.approx(brute_measures(t), rel=1e-6)
        assert not counts[2].any() and not measures[2].any()


def test_sample_is_bounded_and_follows_from_rows(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i % 50}") for i in range(5000)] + [(None, "no id"), (7, "another text"), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 60, i % 2, 0) for i in range(600)] + [(None, 1, 0), (3, None, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    take = lambda n, d=docs: sorted(map(tuple, quality.labelled_sample(d, labels, label="quality", most_rows=n).collect()))
    assert len(take(1000)) == 50 and (0, "another text") in take(1000) and (0, "") in take(1000)
    assert len(take(20)) <= 20 and take(20) == take(20, docs.repartition(9))


def test_odd_rows_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (12, 0), (9, 1)], "doc_id long, quality int")
    model = quality.fit(quality.labelled_sample(odd, labels, label="quality"))
    got = quality.score(odd, model)
    rows = got.collect()
    assert got.columns == ["doc_id", "score"] and len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(none, model).collect() == []
    blank = quality.fit(quality.labelled_sample(none, labels, label="quality"))
    assert {r["score"] for r in quality.score(odd, blank).collect()} == {0.5}
    one = quality.fit(quality.labelled_sample(odd, labels.where("quality = 1"), label="quality"))
    assert {r["score"] for r in quality.score(odd, one).collect()} == {1.0}


def test_held_out_accuracy(spark):
    """No row that is held out is learned from; of these nearly all are told rightly."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = queries.op13_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.98 and np.mean([s >= 0.5 for s in good]) > 0.99 and np.mean([s < 0.5 for s in bad]) > 0.95
    learned = quality.labelled_sample(docs, labels.where(~quality.held_out()), label="quality")
    held = docs.join(labels, "doc_id").where(quality.held_out()).select("text")
    assert 0 < learned.count() <= 4000 and learned.select("text").exceptAll(held.distinct()).count() > 0.9 * learned.count()
