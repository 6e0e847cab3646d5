"""Toxicity and benchmark decontamination against plain Python, and toxicity's accuracy on rows held out."""

import math
import random

import pytest

from millrace.llm import decontamination as dec
from millrace.llm import queries
from millrace.llm import toxicity as tox

SF = "/root/testdata/sf0.1"  # 120 toxic rows are held out there


def test_folding():
    assert tox.fold("1d10t") == tox.fold("ІDІОТ") == tox.fold("ｉｄｉｏｔ") == tox.fold("!ID!IOT".replace("!", "")) == " idiot "
    for hidden in ("id\u200biot", "i\u0301d\u0308iot", "𝓲𝓭𝓲𝓸𝓽", "ⓘⓓⓘⓞⓣ", "id!ot!", "ıdıοt", "IDI\u00adOT", "\ufeff1di0т"):
        assert tox.fold(hidden) == " idiot "
    assert tox.fold("") == tox.fold(" -- ") == "  " and tox.fold("a_b-c") == " a b c "


def test_exceptions_and_lengths():
    model = tox.Model({" loser ": 4.0, " pathet": 2.0}, ("sore loser",), 1.0)
    found = tox.matcher(model)
    assert tox.weigh(found, tox.fold("a sore loser")) == (0, 0)
    assert tox.weigh(found, tox.fold("a sore loser, and a LOSER! pathetic")) == (6.0, 2)
    assert tox.weigh(found, tox.fold("losers unpathetic")) == (0, 0)


def weight(model, text):
    """The heaviest term of each word outside of exception phrases, summed, and the words."""
    folded = tox.fold(text or "")
    spared = set()
    for phrase in map(tox.fold, model.exceptions):
        at = folded.find(phrase)
        while at >= 0:
            spared.update(range(at, at + len(phrase) - 1))
            at = folded.find(phrase, at + 1)
    total, at, n = 0.0, 0, 0
    for word in folded.split():
        place = folded.index(f" {word} ", at)
        at = place + len(word) + 1
        n += 1
        if place not in spared:
            total += max([w for t, w in model.terms.items() if (f" {word} " == t or (t[-1] != " " and f" {word}".startswith(t)))], default=0.0)
    return total, n


def brute_score(model, text):
    total, n = weight(model, text)
    return 1 - 0.7 ** (total / (1 + math.log1p(n / 50)) / model.threshold)


def test_scores(spark, odd, none):
    rng = random.Random(4)
    vocabulary = ["idiot", "idiotic", "l0ser", "sore", "loser", "fine", "day", "тrash", "can", "ab"]
    model = tox.Model({" idiot ": 3.0, " idio": 2.0, " loser ": 4.0, " trash ": 1.5}, ("sore loser", "trash can"), 0.8)
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for i in range(300)] + [(None, None), (5, "idiot"), (5, "x " * 50_000 + "idiot")]
    got = tox.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    want = sorted((str(i), round(brute_score(model, t), 9)) for i, t in rows)
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in got) == want and all(0 <= r["score"] < 1 for r in got)
    kept = tox.without_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1 and tox.without_toxic(none, model).collect() == []
    assert tox.score(odd, model).count() == odd.count() and tox.score(none, model).collect() == []


def test_fit_without_labels(spark, odd):
    labels = spark.createDataFrame([(None, 1), (1, None), (77, 1)], "doc_id long, toxic int")
    model = tox.fit(tox.labelled_sample(odd, labels, label="toxic"), label="label", text="text")
    assert set(model.terms) == {f" {w} " for w in tox.SEED}


def test_fit_follows_from_the_rows(spark):
    """Copies in any order and partitioning give one model, however many terms there are."""
    rng = random.Random(2)
    rows = [(i % 2, " ".join(rng.choice(["bad", "worse"] if i % 2 and rng.random() < 0.2 else [f"w{rng.randrange(40)}"]) for _ in range(30))) for i in range(120)]
    rows += [(y, t + " tail") for y, t in rows[:60]]
    models = []
    for parts in (1, 7):
        rng.shuffle(rows)
        models.append(tox.fit(spark.createDataFrame(rows, "label int, text string").repartition(parts), label="label", text="text"))
    assert models[0] == models[1] and " bad " in models[0].terms


def test_held_out_accuracy(spark):
    scored = queries.op8_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").where("toxic IS NOT NULL")
    rows = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    bad, good = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    hits = sum(r["predicted"] for r in rows if r["toxic"] == 1)
    assert auc > 0.9 and hits >= 0.8 * len(bad) and sum(r["predicted"] for r in rows if r["toxic"] == 0) <= 0.02 * len(good)


def nearest(item, text, most):
    """Sellers' table, row by row."""
    column, best = list(range(len(item) + 1)), None
    for at, w in enumerate(text):
        new = [0]
        for i, v in enumerate(item):
            new.append(min(column[i] + (v != w), column[i + 1] + 1, new[i] + 1))
        column = new
        if column[-1] <= most and (best is None or column[-1] < best[0]):
            best = column[-1], at + 1
    return best


@pytest.mark.parametrize("seed", range(3))
def test_myers(seed):
    rng = random.Random(seed)
    for _ in range(200):
        item = [rng.choice("abcd") for _ in range(rng.randrange(1, 90))]
        text = [rng.choice("abcde") for _ in range(rng.randrange(0, 60))] + item[: rng.randrange(len(item) + 1)]
        most = rng.randrange(0, len(item))
        assert dec.myers(item, text, most) == nearest(item, text, most)


def test_items_with_one_id(spark, monkeypatch):
    """Of several items with one id each is found, in one block or in many, and only one block is held at a time."""
    items = [(i % 3, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(12)]
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    docs = [(i, f"before {t} after") for i, (_, t) in enumerate(items)] + [(100, "clean words only")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert dec.without_contaminated(table, bench).count() == 1
    written = []
    monkeypatch.setattr(dec, "staged", lambda df, name, f=dec.staged: written.append(name) or f(df, name))
    for block_bytes in (16 << 20, 100):
        got = dec.contaminated(table, bench, block_bytes=block_bytes).collect()
        assert sorted((r["doc_id"], r["item_id"], r["distance"], r["n_words"]) for r in got) == [(i, item, 0, 12) for i, (item, _) in enumerate(items)]
        assert [r["doc_id"] for r in dec.without_contaminated(table, bench, block_bytes=block_bytes).collect()] == [100]
        assert bool(written) == (block_bytes == 100)
    n, words = dec.blocks(bench, "item_id", "text", 100)
    assert n > 3 and written.count("hits") == written.count("clean") == n and sum(len(b) for b in words) == 12


def test_contaminated(spark, odd, none):
    rng = random.Random(9)
    items = {i: [f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 45))] for i in range(20)}
    docs = []
    for d in range(150):
        text = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            part = list(items[rng.randrange(20)])
            for _ in range(rng.randrange(0, 1 + len(part) // 7)):
                at = rng.randrange(len(part))
                part[at : at + rng.randrange(2)] = [f"w{rng.randrange(50)}"][: rng.randrange(2)]
                part = part or ["x"]
            text += part + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 9))]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in text)))
    docs += [(None, docs[0][1]), (7, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    items[None] = ["w1", "w2"]  # an item without an id is one as any other
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()] + [(99, None), (98, " - ")], "item_id long, text string")
    want = []
    for d, t in docs:
        ws = dec.normal(t or "").split()
        for i, item in items.items():
            hit = nearest(item, ws, dec.budget(len(item), 0.1))
            if hit:
                want.append((d, i, *hit, len(item)))
    for block_bytes in (16 << 20, 300):
        got = dec.contaminated(table, bench, block_bytes=block_bytes).collect()
        assert sorted(((r["doc_id"], r["item_id"], r["distance"], r["end_word"], r["n_words"]) for r in got), key=str) == sorted(want, key=str)
        held = {d for d, *_ in want}
        assert sorted((r["doc_id"] for r in dec.without_contaminated(table, bench, block_bytes=block_bytes).collect()), key=str) == sorted((d for d, t in docs if not any(w[0] == d for w in want) or (d == 7 and t is None)), key=str)
        assert held
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dec.contaminated(table, empty).collect() == [] and dec.contaminated(none, bench).collect() == []
    kept = dec.without_contaminated(odd, empty)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_items_without_an_id(spark):
    """Benchmark items with a null id are matched as others are, and documents that hold them go."""
    item = "the quick brown fox jumps over the lazy dog near the old river bank"
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "something else"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (None, item), (None, None), (4, "another item of eight words is not here")], "item_id long, text string")
    got = dec.contaminated(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in got] == [(1, None, 0)]
    assert sorted(r["doc_id"] for r in dec.without_contaminated(docs, bench).collect()) == [2, 3]


def test_every_heavy_term_is_kept(spark):
    """No limit but share and weight stands between a term and the lexicon."""
    bad, rng = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)], random.Random(1)
    rows = [(1, " ".join(rng.sample(bad, len(bad)))) for i in range(8)] + [(0, f"clean words {'abcdefghijklmnopqrstuvwxyz'[i]}") for i in range(26)] * 4
    model = tox.fit(spark.createDataFrame(rows, "label int, text string"), label="label", text="text", least_weight=1.0)
    assert len(model.terms) >= 3000


def test_a_bounded_sample_of_repeated_rows(spark):
    docs = spark.range(3000).selectExpr("id % 5 AS doc_id", "concat('text ', id % 5) AS text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(None, 1), (0, 1)], "doc_id long, toxic int")
    got = sorted(map(tuple, tox.labelled_sample(docs, labels, label="toxic").collect()))
    assert got == sorted([(i % 2, f"text {i}") for i in range(5)] + [(1, "text 0")])
