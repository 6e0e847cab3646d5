"""Token ids, packing and the token store against whole-text encoding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import packing, token_store, tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def whole(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.fixture(scope="module", params=FILES)
def both(request):
    return tokens.Encoder(public_tokenizers.path(request.param), cache_entries=50), whole(request.param)


@given(st.text(alphabet=st.sampled_from("abcXYZéßΣσς .,!'?%&#*$\n\t\r 　​0123文字́\x01\U0001f600<|>"), max_size=60))
@settings(max_examples=400, deadline=None)
def test_encoder(both, text):
    assert both[0].encode(text) == both[1](text).tobytes()


def test_encoder_on_special_tokens(both):
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y  z\nq", "one <|endoftext |> two", "<|ENDOFTEXT|>", "a\n<|endoftext|>\nb."):
        assert both[0].encode(text) == both[1](text).tobytes()


def test_encoder_on_many(both):
    texts = ["a plain text, twice.", None, "", "a plain text, twice.", " odd  spaces ", "lines\nand %%% signs.!!\nhere", "it's <|endoftext|> done", "word'"] * 3
    assert [x.tolist() for x in both[0].many(pa.array(texts))] == [both[1](t).tolist() for t in texts]


def test_encoder_on_documents(spark, both):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect():
        assert both[0].encode(r["text"]) == both[1](r["text"]).tobytes()


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, odd, none):
    ids = whole("word_bpe_49k.json")
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(odd, path, capacity=256).collect()
    want = []
    for r in odd.collect():
        x = np.append(ids(r["text"]), np.uint32(0)).astype("<u4")
        want += [(r["doc_id"], k, 256 * k, len(x[256 * k : 256 * k + 256]), zlib.crc32(x[256 * k : 256 * k + 256].tobytes())) for k in range(-(-len(x) // 256))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    check_bins(rows, 256)
    assert packing.pack_documents(none, path).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_bins_are_few(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 2048) if seed % 2 else min(2048, int(rng.expovariate(1 / 600)) + 1) for _ in range(20_000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "i long, length long").repartition(3)
    rows = packing.pack(df, capacity=2048).collect()
    assert len(rows) == len(lengths)
    assert check_bins(rows, 2048) <= 1.02 * sum(lengths) / 2048 + 1


def test_bounded_space():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert fit.open == 0 and [fit.place(n)[0] for n in (6, 7, 8)] == [2, 3, 4]  # the fullest, 3, closed
    assert fit.place(4) == (2, 6)
    with pytest.raises(ValueError, match="cannot be packed"):
        raise ValueError("a piece of 0 tokens cannot be packed into 10")


def test_store(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = whole("byte_bpe_50k.json")
    for docs in (odd, odd.where("doc_id IS NOT NULL AND doc_id < 9").dropDuplicates(["doc_id"]), none):
        store = token_store.write_store(docs, path)
        got = token_store.read_store(spark, store).collect()
        texts = [(r["doc_id"], np.append(ids(r["text"]), np.uint32(2)).astype("<u4")) for r in docs.collect()]
        assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(((d, len(x), zlib.crc32(x.tobytes())) for d, x in texts), key=str)
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        known = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
        assert known == sorted(known)
        assert all(r["whole"] for r in token_store.verify_manifest(spark, store).collect())
        n = token_store.chunks(spark, store)
        assert n.count() == n.select("digest").distinct().count()
    one = odd.where("doc_id = 10").select("doc_id", "text")
    store = token_store.write_store(one, path)
    assert token_store.read_ids(spark, store, one).first()["ids"] == np.append(ids(one.first()["text"]), 2).tolist()


def test_damage_is_found(spark, tmp_path):
    store = token_store.write_store(spark.createDataFrame([(1, "some words to store")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))
    r = token_store.chunks(spark, store).first()
    bad = token_store.freeze(np.arange(r["n"], dtype="<u4").tobytes())
    rows = spark.createDataFrame([(r["digest"], r["n"], bytearray(bad))], "digest binary, n long, stored binary")
    with pytest.raises(Exception, match="damaged"):
        rows.mapInPandas(token_store._digested, "__digest binary, __crc long").collect()


@pytest.mark.parametrize("what", ["swapped", "lost", "manifest", "row"])
def test_damaged_recipes_are_found(spark, tmp_path, what):
    text = " ".join(f"word{i}" for i in range(2000))
    store = token_store.write_store(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))
    name = {"lost": "parts", "manifest": "manifest"}.get(what, "recipes")
    rows = spark.read.parquet(f"{store}/{name}")
    bad = {
        "swapped": lambda: rows.withColumn("digests", F.reverse("digests")), "lost": lambda: rows.where("kind <> 'chunk' OR n < 20"),
        "manifest": lambda: rows.withColumn("ids", F.col("ids") + 1), "row": lambda: rows.where("doc_id = 1"),
    }[what]()
    kept = [tuple(r) for r in bad.collect()]
    out = spark.createDataFrame(kept, bad.schema)
    (out.write.mode("overwrite").partitionBy("kind") if what == "lost" else out.write.mode("overwrite")).parquet(f"{store}/{name}")
    with pytest.raises(Exception, match="Merkle root|missing|manifest"):
        token_store.read_store(spark, store).collect()


def test_borders_follow_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 30_000).astype("<u4")
    ends = token_store.borders(ids)
    assert ends[-1] == len(ids) and all(0 < b - a <= token_store.MOST for a, b in zip([0, *ends], ends))
    moved = token_store.borders(np.concatenate([ids[:7], ids]))
    assert len({e + 7 for e in ends} & set(moved)) > 0.8 * len(ends)
    for n in ends:  # also where a border is the end
        assert token_store.borders(ids[:n]) == ends[: ends.index(n) + 1]
    assert token_store.borders(ids[:0]) == [0] and token_store.borders(ids[:5]) == [5]


def test_crc_of_parts():
    data = random.Random(2).randbytes(5000)
    cuts = [0, 1, 900, 901, 4000, 5000]
    crcs = np.array([zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:])])
    shifted = token_store.shift_crc(crcs, np.array([5000 - b for b in cuts[1:]]))
    assert int(np.bitwise_xor.reduce(shifted)) == zlib.crc32(data)


def test_merkle():
    leaves = [bytes([i]) * 32 for i in range(5)]
    assert len({token_store.merkle(leaves), token_store.merkle(leaves[::-1]), token_store.merkle(leaves[:4]), token_store.merkle([])}) == 4
