"""Near-duplicates and repeated windows against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import components, near_dedup, substring_dedup, words

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def families(rng, n):
    """Texts in families of copies with more and more changed words."""
    docs = []
    for f in range(n):
        base = [f"f{f}w{rng.randrange(60)}" for _ in range(rng.randrange(4, 90))]
        for c in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                text[rng.randrange(len(text))] = f"c{c}{rng.random()}"
            docs.append((len(docs), rng.choice([" ", "  ", "\n"]).join(text)))
    rng.shuffle(docs)
    return docs


def brute(docs, k, percent):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().translate(LOWER).split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    docs = families(random.Random(k), 40)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=k, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute(docs, k, percent)


def test_many_blocks(spark, monkeypatch):
    """Families larger than a block are compared across blocks."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for d in range(300):
        text = list(base)
        for _ in range(rng.randrange(0, 14)):
            text[rng.randrange(150)] = f"{d}.{rng.random()}"
        docs.append((d, " ".join(text)))
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    monkeypatch.setattr(near_dedup, "HUB", 8)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=3, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute(docs, 3, 85)


def test_shared_passages_make_no_family(spark, monkeypatch):
    """Texts that share bands by a common passage, but are far from alike, are not compared in full: such families grow faster than the input."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(24)]
    docs = [(d, " ".join(passage + [f"{d}.{i}" for i in range(rng.randrange(14, 20))])) for d in range(120)]
    docs += [(1000 + d, " ".join([f"q{i}" for i in range(60)] + [f"x{d}"])) for d in range(5)]
    joined = []
    monkeypatch.setattr(near_dedup, "components", lambda edges, made=near_dedup.components: joined.append({x for e in edges.collect() for x in e}) or made(edges))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=3, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute(docs, 3, 85)
    assert 5 <= len(joined[0]) < 12  # of 125; sketches take a few pairs for more alike than they are


@pytest.mark.parametrize("bucket", [2, 1 << 14])
def test_buckets_of_any_size(spark, monkeypatch, bucket):
    """Larger buckets than are sieved, and batches that end within buckets and families, change nothing."""
    docs = families(random.Random(9), 30)
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=3, percent=85).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute(docs, 3, 85)


def test_groups_are_whole():
    """Every table holds whole groups, wherever batches end."""
    rng = random.Random(2)
    for _ in range(60):
        rows = sorted((rng.randrange(4), rng.randrange(3)) for _ in range(rng.randrange(0, 25)))
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(0, 9)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in (0, 1)], ["x", "y"]) for part in parts]
        groups = [list(zip(t.column("x").to_pylist(), t.column("y").to_pylist()))[a:b] for t, at in near_dedup._whole(batches, ["x", "y"]) for a, b in zip(at[:-1], at[1:])]
        assert sum(groups, []) == rows and len(groups) == len(set(rows)) and all(len(set(g)) == 1 for g in groups)


def test_buckets_join_what_chains_of_alike_pairs_connect():
    """In a bucket one edge fewer than nodes for each chain of alike pairs, whatever its first node is alike to."""
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 2**63, 400, dtype=np.uint64) for _ in range(3)]
    near = lambda s, n: np.concatenate([s[n:], rng.integers(0, 2**63, n, dtype=np.uint64)])
    sets = [near(base[0], 0), near(base[1], 0), near(base[1], 8), near(base[2], 0), near(base[0], 8), near(base[1], 16), base[2][:300]]
    sets.append(near(sets[4], 60))  # about as near to base[0] by way of the fifth alone
    sketch = [near_dedup.odd_sketch(near_dedup.minhash(np.unique(s))).tobytes() for s in sets]
    bands = [1] * len(sets) + [2, 2]
    columns = {"band": bands, "node": [*range(10, 10 + len(sets)), 10, 11], "sketch": [*sketch, sketch[0], sketch[1]], "n_shingles": [*(len(s) for s in sets), 400, 400]}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "sketch" else pa.int64()) for k, v in columns.items()})
    edges = {frozenset(e) for b in near_dedup._alike(85)([batch.slice(0, 3), batch.slice(3)]) for e in zip(b.column("a").to_pylist(), b.column("b").to_pylist())}
    root = {n: n for n in range(10, 10 + len(sets))}
    for a, b in (sorted(e) for e in edges):
        low, high = sorted((root[a], root[b]))
        assert low != high
        root = {n: low if r == high else r for n, r in root.items()}
    assert root[14] == root[10] == root[17] and root[11] == root[12] == root[15] == 11 and root[13] == 13 and root[16] == 16


def test_odd_rows_near(spark, odd, none, rows_of):
    got = near_dedup.near_duplicates(odd, shingle=3, percent=85).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)] and by[6] == [(0, 6, True)] and by[7] == [(1, 7, True)] and by[8] == [(1, 8, True)]
    assert by[1] == [(118, None, False)] and by[3] == [(118, None, False)]  # the null id is the least
    assert near_dedup.near_duplicates(none).collect() == []
    kept = near_dedup.one_of_each(odd, shingle=3, percent=85)
    assert kept.columns == odd.columns and (1, odd.first()["text"]) not in rows_of(kept) and near_dedup.one_of_each(none).collect() == []


def test_one_row_of_each_stays(spark):
    """Repeated rows, near copies under one id and null ids leave one row of each group; blank rows all stay."""
    rng = random.Random(4)
    a, b, c, d, e = ([f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(5))
    near = lambda ws: " ".join([*ws[:-1], "x"])
    text = " ".join
    rows = [(1, text(a)), (1, text(a)), (2, text(b)), (2, near(b)), (3, text(c)), (4, near(c)), (3, text(d)), (None, text(e)), (None, text(e)), (9, near(e)), (4, text(a)), (5, None), (5, None), (6, " \t")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
    got = near_dedup.one_of_each(docs, shingle=5, percent=80)
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert got.columns == docs.columns
    assert sorted((k for k in kept if k[0] != 2), key=str) == sorted([(1, text(a)), (3, text(c)), (3, text(d)), (None, text(e)), (5, None), (5, None), (6, " \t")], key=str)
    assert len([k for k in kept if k[0] == 2]) == 1
    cut = substring_dedup.cut_repeats(got, width=50).collect()
    assert [r["text"] for r in cut if r["doc_id"] == 1] == [text(a)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(a, a + 1) for a in range(50)] + [(1000, 1000 + i) for i in range(1, 60)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)] + [(5, 5)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {}
    for n in got:
        want.setdefault(find(n), set()).add(got[n])
    assert all(len(v) == 1 for v in want.values()) and len({next(iter(v)) for v in want.values()}) == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_odd_sketch_estimates():
    rng = np.random.default_rng(3)
    limit = near_dedup.most_odd_bits(85)
    for _ in range(20):
        both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (900, 60, 60))
        sketches = [np.frombuffer(near_dedup.odd_sketch(near_dedup.minhash(np.unique(np.concatenate([both, x])))).tobytes(), np.uint64) for x in (a, b)]
        assert np.bitwise_count(sketches[0] ^ sketches[1]).sum() <= limit
    far = [np.frombuffer(near_dedup.odd_sketch(near_dedup.minhash(np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64)))).tobytes(), np.uint64) for _ in range(2)]
    assert np.bitwise_count(far[0] ^ far[1]).sum() > limit


def repeats(docs, width):
    """By row: words, kept words."""
    parts = [(t or "").encode().split() for _, t in docs]
    counts = Counter(tuple(w[i : i + width]) for w in parts for i in range(len(w) - width + 1))
    out = []
    for w in parts:
        keep = [True] * len(w)
        for i in range(len(w) - width + 1):
            if counts[tuple(w[i : i + width])] > 1:
                keep[i : i + width] = [False] * width
        out.append((len(w), [x for x, k in zip(w, keep) if k]))
    return out


@pytest.mark.parametrize("width", [9, 20, 35])
def test_repeats(spark, width):
    rng = random.Random(width)
    passages = [[f"p{p}.{rng.randrange(30)}" for _ in range(rng.randrange(width - 3, 3 * width))] for p in range(12)]
    docs = []
    for d in range(120):
        text = []
        for _ in range(rng.randrange(0, 5)):
            text += [f"d{d}.{rng.randrange(9999)}" for _ in range(rng.randrange(0, 40))]
            if rng.random() < 0.4:
                p = rng.choice(passages)
                a = rng.randrange(0, len(p) // 2)
                text += p[a : a + rng.randrange(width // 2, 2 * width)]
            if rng.random() < 0.1:
                text += ["same"] * rng.randrange(0, 2 * width)
        docs.append((d, rng.choice([" ", "\n", " \t "]).join(text)))
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), width=width).collect()}
    for (d, _), (n, kept) in zip(docs, repeats(docs, width)):
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept"].encode()) == (n, n - len(kept), b" ".join(kept))


def test_odd_rows_repeats(spark, odd, none, rows_of):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = sorted(((d, n, n - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for (d, _), (n, k) in zip(docs, repeats(docs, 35))), key=str)
    got = substring_dedup.remove_repeats(odd, width=35).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got), key=str) == want
    cut = substring_dedup.cut_repeats(odd, width=35)
    assert cut.columns == odd.columns
    texts = dict(rows_of(cut))
    assert texts[4] is None and texts[6] == " \t\n" and texts[8] == "one  TWO" and texts[1] == "" and texts[10] == "end"
    assert substring_dedup.remove_repeats(none).collect() == [] and substring_dedup.cut_repeats(none).collect() == []


def test_word_hashes():
    w = words.Words([b"a bb  a", b"", b"\nBB a\x0bx\xc2\xa0y"], lower=True)
    assert list(np.diff(w.first)) == [3, 0, 3]
    assert w.hashes[0] == w.hashes[2] == w.hashes[4] and w.hashes[1] == w.hashes[3]
    assert words.spans(w.hashes, np.array([1]), np.array([3])) == words.spans(w.hashes, np.array([3]), np.array([5]))
    assert words.spans(w.hashes, np.array([2]), np.array([2])) == 0


def thue_morse(n, a, b):
    return [a if bin(i).count("1") % 2 == 0 else b for i in range(n)]


def test_hashes_tell_structured_runs_apart():
    """Sequences on which polynomials modulo a power of two collide, as bytes of a word and as words of a run."""
    one, other = ("".join(thue_morse(2048, *p)).encode() for p in ("ab", "ba"))
    assert len(set(words.Words([one, other, one]).hashes.tolist())) == 2
    for n in (512, 1024, 3000):
        runs = words.Words([" ".join(thue_morse(n, *p)).encode() for p in (("x", "y"), ("y", "x"), ("x", "y"))])
        got = words.spans(runs.hashes, runs.first[:-1], runs.first[1:])
        assert got[0] == got[2] != got[1]


def test_hashes_of_words_of_all_lengths():
    """Words differ in hash where they differ in bytes or length; a word's hash does not depend on what stands around it."""
    rng = random.Random(3)
    texts = {bytes(rng.choice(b"ab") for _ in range(n)) for n in list(range(1, 140)) * 20} | {b"a" * n for n in range(1, 200)}
    texts |= {b"a" * n + b"b" for n in range(1, 200)} | {"ä".encode() * n for n in range(1, 90)}
    texts = sorted(texts)
    alone = [words.Words([t]).hashes[0] for t in texts]
    assert len(set(alone)) == len(texts)
    assert words.Words([b" \n".join(texts)]).hashes.tolist() == alone
    assert words.Words([t.upper() for t in texts if t.isascii()], lower=True).hashes.tolist() == [h for t, h in zip(texts, alone) if t.isascii()]


def test_spans_against_sequences():
    rng = random.Random(4)
    w = words.Words([" ".join(rng.choice("ab") for _ in range(400)).encode()])
    names = {}
    for size in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 35, 64, 100):
        for i, h in enumerate(words.windows(w.hashes, size).tolist()):
            names.setdefault(h, set()).add(tuple(w.hashes[i : i + size].tolist()))
    assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == len(names)


def test_long_words_of_one_structure_are_not_linked_or_removed(spark):
    one, other = ("".join(thue_morse(2048, *p)) for p in ("ab", "ba"))
    rest = [f"w{i}" for i in range(41)]
    docs = [(1, one), (2, other), (3, " ".join(rest[:20] + [one] + rest[21:])), (4, " ".join(rest[:20] + [other] + rest[21:]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    near = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, shingle=3, percent=90).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 4: 4} == {d: v[1] for d, v in brute(docs, 3, 90).items()}
    assert {r["n_removed"] for r in substring_dedup.remove_repeats(df, width=35).collect()} == {0}


def test_a_row_listed_very_often(spark):
    """A repeated row is one set to compare and one list of runs."""
    base = " ".join(f"w{i}" for i in range(90))
    copies = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(base).alias("text"))
    others = spark.createDataFrame([(6, base.replace("w40", "x")), (7, base + " and more"), (8, "apart")], "doc_id long, text string")
    docs = copies.union(others).repartition(8)
    got = near_dedup.near_duplicates(docs, shingle=3, percent=85).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(5, 5, True, 20_000), (6, 5, False, 1), (7, 5, False, 1), (8, 8, True, 1)]
    keyed = substring_dedup._keyed(docs, "doc_id", "text")
    listed = substring_dedup._listed(keyed, 35).collect()
    assert len(listed) == 3 and all(len(r["__runs"]) <= 90 and len(set(zip(r["__starts"], r["__runs"]))) == len(r["__runs"]) for r in listed)
    removed = substring_dedup.remove_repeats(docs, width=35).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, removed)) == [(5, 90, 90, 20_000), (6, 90, 89, 1), (7, 92, 90, 1), (8, 1, 0, 1)]
