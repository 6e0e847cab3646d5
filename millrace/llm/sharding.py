"""Weighted rendezvous sharding of stable record keys. DataFrame functions only.

Every shard draws one pseudo-random number for a key from md5(key:shard); the shard with the smallest
``-ln(u) / weight`` takes the record. A shard that is added draws its own number and changes none of the others', so it
only takes records into itself, in proportion to its weight. No state, no coordination and no shuffle is needed to place
a record; only slot numbers shuffle, and they carry a few integers and no text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import staged, utf8

#: 48 bits of md5 make one draw.
DRAW_BITS = 48


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that only the key and the shard decide."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{shard}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("double") + 0.5) / float(2**DRAW_BITS)


def best_bid(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(bid, shard): the least bid for ``key`` of the shards from ``first`` on. A null key is one key of its own."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    bids = [F.struct((-F.log(draw(key, i)) / F.lit(float(w))).alias("bid"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if i >= first]
    return F.array_min(F.array(*bids))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key`` among ``len(weights)`` shards."""
    return best_bid(key, weights)["shard"]


def shard_records(
    df: DataFrame, key: str, text: str, weights: Sequence[float], *, grown: Sequence[float] | None = None,
    extra_bytes: int = 8, rows_per_block: int = 20_000,
) -> DataFrame:
    """Places each row of ``df``: key, size, text_crc32, shard, slot, and grown_shard with the weights ``grown``.

    ``slot`` numbers a shard's rows from 0 without gaps. Blocks are parts of a shard chosen by a hash of a row's key and
    its place in the scan, so a key that a third of all rows share is in many of them; they number their own rows, and
    offsets come from one count for each block, so a shard of any size is numbered by many tasks.
    A null text has no bytes and crc 0; a null key is placed like any other key. An empty table gives no rows.
    Placed rows, a few numbers each, are written once for the counts and the slots.
    """
    weights = list(weights)
    n = df.count()
    blocks = max(1, -(-n // (len(weights) * rows_per_block)))
    rows = df.select(
        F.col(key).alias("__key"),
        (F.octet_length(utf8(F.col(text))) + extra_bytes).cast("long").alias("size"),
        F.crc32(utf8(F.col(text))).alias("text_crc32"),
    ).withColumn("__text", F.coalesce(F.col("__key").cast("string"), F.lit("null")))
    block = F.pmod(F.xxhash64("__text", F.monotonically_increasing_id()), F.lit(blocks))
    rows = rows.withColumn("__best", best_bid(F.col("__text"), weights)).withColumn("shard", F.col("__best.shard")).withColumn("__block", block)
    if grown is None:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    elif list(grown[: len(weights)]) == weights:  # the old shards' bids are known
        more = F.least("__best", best_bid(F.col("__text"), grown, len(weights))) if len(grown) > len(weights) else F.col("__best")
        rows = rows.withColumn("grown_shard", more["shard"])
    else:
        rows = rows.withColumn("grown_shard", rendezvous(F.col("__text"), grown))
    rows = staged(rows.drop("__text", "__best"), "placed")
    counts = rows.groupBy("shard", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("shard", "__block").orderBy("__key", "size", "text_crc32")
    return (
        rows.join(counts, ["shard", "__block"])
        .withColumn("slot", (F.col("__base") + F.row_number().over(within) - 1).cast("long"))
        .select(F.col("__key").alias(key), "size", "text_crc32", "shard", "slot", "grown_shard")
    )
