"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document into chunks whose borders depend on the ids around them alone, so shared
passages give equal chunks wherever they stand. The store is three Parquet tables in one folder:

* ``chunks``: digest (sha256 of the ids as little-endian unsigned 32-bit integers), n, and the ids, stored once each as
  16-bit integers where all fit and 32-bit ones otherwise, compressed by zstd;
* ``recipes``: for each document, in ascending order of ids over its files: start (ids of all documents before it),
  n_tokens, its chunks' digests and where each ends, in order, and its Merkle root over these;
* ``manifest``: for each range of recipes: documents, ids and the Merkle root over their roots.

Chunks are dealt by digest once and sorted there, so that copies meet as neighbours and no task remembers digests; each
task sends a digest's ids at most once, so a passage that fills a third of the corpus costs one chunk for each task.
Reading back digests each stored chunk by itself, makes every recipe's Merkle root anew and compares it, and compares the
manifest with the roots. Documents' checksums are put together from their chunks' (crc32 is linear), so no ids are
shuffled to verify the whole store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import tokens
from millrace.llm.shared import new_path, running_total

#: A border stands where the rolling hash of the last WINDOW ids has its MASK bits clear; chunks have LEAST to MOST ids.
WINDOW, MASK, LEAST, MOST = 16, np.uint64(0x3FF << 40), 128, 4096
_FACTOR = 0x9E3779B97F4A7C15


def borders(ids: np.ndarray) -> list[int]:
    """Where chunks of ``ids`` end; the last is len(ids)."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    rolling, size, factor = mixed, 1, _FACTOR
    while size < WINDOW:  # the hash of twice as many ids from two hashes
        rolling = rolling[:-size] * np.uint64(factor) + rolling[size:]
        size, factor = size * 2, factor * factor % 2**64
    ends = np.flatnonzero((rolling & MASK) == 0) + WINDOW
    out, at = [], 0
    for end in [*ends.tolist(), n]:
        while end - at > MOST:
            at += MOST
            out.append(at)
        if end - at >= LEAST or at < end == n:
            at = end
            out.append(at)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """The root over digests; an odd one moves up as it is. No leaves: the digest of nothing."""
    level = list(leaves) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + ([level[-1]] if len(level) % 2 else [])
    return level[0]


_PRESS, _UNPRESS = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()


def freeze(ids: bytes) -> bytes:
    """32-bit ids in their stored form: a width byte, then compressed ids."""
    wide = np.frombuffer(ids, "<u4")
    narrow = not len(wide) or int(wide.max()) < 65536
    return (b"\2" if narrow else b"\4") + _PRESS.compress((wide.astype("<u2") if narrow else wide).tobytes())


def thaw(stored: bytes) -> bytes:
    raw = _UNPRESS.decompress(stored[1:])
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if stored[:1] == b"\2" else raw


_ROWS = pa.schema(
    [("kind", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("stored", pa.binary()),
     ("digests", pa.list_(pa.binary())), ("ends", pa.list_(pa.int64()))]
)
_SPARK_ROWS = "kind string, doc_id long, n long, digest binary, stored binary, digests array<binary>, ends array<long>"


def _cut(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, sent = np.array([end_id], "<u4"), set()
        for part, texts in tokens.encoded(batches, vocabulary):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), texts):
                ids = np.concatenate([text, end])
                raw, ends, at, digests = ids.tobytes(), borders(ids), 0, []
                for to in ends:
                    one = raw[4 * at : 4 * to]
                    digest = hashlib.sha256(one).digest()
                    digests.append(digest)
                    if digest not in sent:
                        sent.add(digest)
                        rows.append(("chunk", None, to - at, digest, freeze(one), None, None))
                    at = to
                rows.append(("recipe", doc, len(ids), merkle(digests), None, digests, ends))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)

    return run


def _manifest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one range after the other, in order; the roots of a range are folded as they come."""
    part, stack, docs, ids = None, [], 0, 0

    def done() -> pd.DataFrame:
        roots = [root for _, root in stack]
        while len(roots) > 1:
            roots[-2:] = [hashlib.sha256(roots[-2] + roots[-1]).digest()]
        return pd.DataFrame({"range": [part], "documents": [docs], "ids": [ids], "root": roots})

    for pdf in batches:
        for r, n, root in zip(pdf["__range"], pdf["n_tokens"], pdf["root"]):
            if r != part:
                if part is not None:
                    yield done()
                part, stack, docs, ids = r, [], 0, 0
            docs, ids = docs + 1, ids + int(n)
            stack.append((0, root))
            while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
                (height, left), (_, right) = stack[-2:]
                stack[-2:] = [(height + 1, hashlib.sha256(left + right).digest())]
    if part is not None:
        yield done()


def write_store(docs: DataFrame, vocabulary: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Encodes every text of ``docs``, writes the store and gives its folder.

    A null or empty text is the end id alone. A null doc_id comes first and stays null; rows with equal ids are ordered
    by their content and each has its recipe; no rows make an empty store. Other columns are not read.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "store")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = slim.mapInArrow(_cut(vocabulary, end_id), _SPARK_ROWS)
    key = F.when(F.col("kind") == "chunk", F.col("digest")).otherwise(F.unhex(F.md5(F.concat("digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))))
    dealt = rows.withColumn("__key", F.xxhash64(key)).repartition("__key").sortWithinPartitions("__key", "digest").mapInArrow(_once, _SPARK_ROWS)
    dealt.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/parts")
    parts_read = spark.read.schema(_SPARK_ROWS).parquet(f"{path}/parts")
    recipes = parts_read.where("kind = 'recipe'").select(
        "doc_id", F.col("n").alias("n_tokens"), F.col("digest").alias("root"), "digests", "ends"
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = running_total(recipes, ["doc_id", "root"], "n_tokens", "start", parts)
    ordered.repartitionByRange(parts, "__range", "doc_id", "root").sortWithinPartitions("__range", "doc_id", "root").write.option(
        "compression", "zstd"
    ).parquet(f"{path}/recipes")
    kept = spark.read.parquet(f"{path}/recipes")
    kept.select("__range", "doc_id", "root", "n_tokens").repartition("__range").sortWithinPartitions(
        "__range", "doc_id", "root"
    ).mapInPandas(_manifest, "range int, documents long, ids long, root binary").write.parquet(f"{path}/manifest")
    return path


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops further copies of chunks; all copies of a digest stand in a row, but for recipes between them."""
    last = None
    for batch in batches:
        keep = []
        for kind, digest in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            keep.append(kind != "chunk" or digest != last)
            if kind == "chunk":
                last = digest
        yield batch.select(_ROWS.names).filter(pa.array(keep, pa.bool_()))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SPARK_ROWS).parquet(f"{path}/parts").where("kind = 'chunk'").select("digest", "n", "stored")


def _crc_powers() -> list[list[int]]:
    """For each k: where the 32 bits of a crc go when 2**k zero bytes follow."""
    bit = [0xEDB88320] + [1 << i for i in range(31)]
    times = lambda a, v: 0 if not v else _xor(a, v)
    for _ in range(3):
        bit = [times(bit, v) for v in bit]
    out = [bit]
    for _ in range(39):
        out.append([times(out[-1], v) for v in out[-1]])
    return out


def _xor(matrix: list[int], v: int) -> int:
    out = 0
    for i in range(32):
        if v >> i & 1:
            out ^= matrix[i]
    return out


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What each crc adds to that of a text in which ``zeros`` bytes follow."""
    out, zeros = crc.astype(np.uint32), zeros.astype(np.int64)
    for k, matrix in enumerate(_POWERS):
        rows = np.flatnonzero(zeros >> k & 1)
        if len(rows):
            old, new = out[rows], np.zeros(len(rows), np.uint32)
            for i in range(32):
                new ^= np.where(old >> np.uint32(i) & np.uint32(1), np.uint32(matrix[i]), np.uint32(0))
            out[rows] = new
        elif not (zeros >> k).any():
            break
    return out


_POWERS = _crc_powers()


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        raw = [thaw(bytes(s)) for s in pdf["stored"]]
        for digest, n, ids in zip(pdf["digest"], pdf["n"], raw):
            if hashlib.sha256(ids).digest() != bytes(digest) or len(ids) != 4 * n:
                raise ValueError(f"stored chunk {bytes(digest).hex()} is damaged")
        yield pd.DataFrame({"__digest": pdf["digest"], "__crc": [zlib.crc32(i) for i in raw]})


def _refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk of each recipe, with the bytes after it; recipes that do not give their root are an error."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            digests, ends, n, roots = (part.column(i) for i in (3, 4, 2, 5))
            for leaves, to, ids, root in zip(digests.to_pylist(), ends.to_pylist(), n.to_pylist(), roots.to_pylist()):
                if merkle(leaves) != root or len(to) != len(leaves) or to[-1] != ids or any(a >= b for a, b in zip([0, *to], to)):
                    raise ValueError(f"a recipe does not give its Merkle root {root.hex()}")
            row = np.repeat(np.arange(part.num_rows), np.diff(digests.offsets.to_numpy()))
            after = (n.to_numpy()[row] - ends.flatten().to_numpy()) * 4
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i).take(pa.array(row)) for i in range(3)), digests.flatten(), pa.array(after)], ["doc_id", "start", "n_tokens", "__digest", "__after"]
            )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the store's files, with everything verified.

    A stored chunk that does not give its digest, a recipe that does not give its Merkle root, a chunk that is missing
    and a manifest that does not agree with the recipes are errors.
    """
    if not verify_manifest(spark, path).where("NOT whole").isEmpty():
        raise ValueError(f"the manifest of {path} does not agree with its recipes")
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens", "digests", "ends", "root")
    digests = chunks(spark, path).mapInPandas(_digested, "__digest binary, __crc long")
    refs = recipes.mapInArrow(_refs, "doc_id long, start long, n_tokens long, __d binary, __after long")
    shift = F.pandas_udf(lambda crc, zeros: pd.Series(shift_crc(crc.to_numpy(), zeros.to_numpy()).astype(np.int64)), "long")
    found = F.coalesce("__crc", F.raise_error(F.concat(F.lit("a chunk is missing: "), F.hex("__d"))).cast("long"))
    return (
        refs.join(digests, F.col("__d") == F.col("__digest"), "left").withColumn("__crc", found)
        .groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor(shift("__crc", "__after")).alias("ids_crc32"))
    )


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """For each range of recipes, whether there are as many documents and ids, and their roots give its root."""
    found = (
        spark.read.parquet(f"{path}/recipes").select("__range", "doc_id", "root", "n_tokens").repartition("__range")
        .sortWithinPartitions("__range", "doc_id", "root").mapInPandas(_manifest, "range int, documents long, ids long, root binary")
    )
    told = spark.read.parquet(f"{path}/manifest").withColumnsRenamed({"range": "told_range", "root": "told", "documents": "td", "ids": "ti"})
    ok = (F.col("root") == F.col("told")) & (F.col("documents") == F.col("td")) & (F.col("ids") == F.col("ti"))
    both = told.join(found, F.col("told_range") == F.col("range"), "full")
    return both.select(F.coalesce("told_range", "range").alias("range"), F.coalesce(ok, F.lit(False)).alias("whole"))


def read_ids(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The ids themselves of the documents in ``wanted`` (doc_id): doc_id, start, ids."""
    recipes = spark.read.parquet(f"{path}/recipes").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    refs = recipes.select("doc_id", "start", F.posexplode("digests").alias("k", "digest"))
    unpack = F.pandas_udf(lambda s: pd.Series([np.frombuffer(thaw(bytes(x)), "<u4").astype(np.int32) for x in s]), "array<int>")
    found = refs.join(chunks(spark, path), "digest").select("doc_id", "start", "k", unpack("stored").alias("ids"))
    ordered = F.array_sort(F.collect_list(F.struct("k", "ids")))
    return found.groupBy("doc_id", "start").agg(F.flatten(F.transform(ordered, lambda s: s["ids"])).alias("ids"))
