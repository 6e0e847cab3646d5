"""Cumulative-snapshot collapse of logged conversations, and rendering. DataFrame functions only.

A chat client that logs the whole conversation after every turn leaves many snapshots that are prefixes of a later one.
Each turn is hashed with its place; the running exclusive-or of these hashes is the hash of a prefix. A conversation
whose whole hash is the hash of a proper prefix of some other one goes (anti-join); of equal ones the least id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import drop_staged, staged

#: Turns of one conversation in one part of its rendering.
BLOCK = 256
#: Characters of a text by which turns are dealt; whole texts order the turns of a range.
SAMPLED = 64


def prefix_hashes(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, block, n (turns up to here), h1 and h2: the running hashes, and ``last``: the final turn.

    Turns are ordered by (turn, role, text), nulls first; their place in this order is hashed, so gaps in the numbers do
    not matter. Two hashes of 64 bits with other seeds make chance agreement of unequal prefixes negligible. Turns are
    dealt by range of (conv, turn, role, the text's beginning), so a conversation that holds a third of all turns,
    numbered or not, is hashed by many tasks, block by block; only counts and sums of blocks meet, and the driver sees
    beginnings of sampled texts alone.
    """
    t = turns.select(F.col(conv).alias("__c"), F.col(turn).cast("long").alias("__t"), F.col(role).alias("__r"), F.col(text).alias("__x"))
    t = t.repartitionByRange("__c", "__t", "__r", F.substring("__x", 1, SAMPLED)).withColumn("__b", F.spark_partition_id())
    within = Window.partitionBy("__c", "__b").orderBy("__t", "__r", "__x")
    t = staged(t.withColumn("__k", F.row_number().over(within)), "dealt")
    before = Window.partitionBy("__c").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("__c", "__b").agg(F.count("*").alias("__n")).select(
        F.col("__c").alias("__bc"), F.col("__b").alias("__bb"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"),
        F.sum("__n").over(Window.partitionBy("__c")).alias("__total"),
    )
    joined = t.join(blocks, F.col("__c").eqNullSafe(F.col("__bc")) & (F.col("__b") == F.col("__bb"))).withColumn("n", F.col("__base") + F.col("__k"))
    parts = [F.col("n"), F.col("__r"), F.col("__x"), F.col("__r").isNull(), F.col("__x").isNull()]
    upto = Window.partitionBy("__c", "__b").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # by place: equal turns keep theirs
    h = joined.withColumn("__h1", F.xxhash64(F.lit(11), *parts)).withColumn("__h2", F.xxhash64(F.lit(97), *parts))
    h = h.withColumn("__r1", F.bit_xor("__h1").over(upto)).withColumn("__r2", F.bit_xor("__h2").over(upto))
    h = staged(h.select("__c", "__t", "__r", "__x", "__b", "n", "__h1", "__h2", "__r1", "__r2", (F.col("n") == F.col("__total")).alias("last")), "running")
    drop_staged(t)
    sums = h.groupBy("__c", "__b").agg(F.bit_xor("__h1").alias("__s1"), F.bit_xor("__h2").alias("__s2")).select(
        F.col("__c").alias("__sc"), F.col("__b").alias("__sb"),
        F.coalesce(F.bit_xor("__s1").over(before), F.lit(0)).alias("__b1"), F.coalesce(F.bit_xor("__s2").over(before), F.lit(0)).alias("__b2"),
    )
    return h.join(sums, F.col("__c").eqNullSafe(F.col("__sc")) & (F.col("__b") == F.col("__sb"))).select(
        F.col("__c").alias(conv), F.col("__t").alias(turn), F.col("__r").alias(role), F.col("__x").alias(text), F.col("__b").alias("__block"), "n",
        F.col("__r1").bitwiseXOR(F.col("__b1")).alias("h1"), F.col("__r2").bitwiseXOR(F.col("__b2")).alias("h2"), "last",
    )


def collapse(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of maximal conversations, with ``n`` (place from 1) and ``n_turns``.

    Conversations are keyed by all their turns, so rows with a null id form one conversation; repeated turns are turns
    of their own, as are turns without a number; null roles and texts differ from empty ones; an empty table gives no
    rows. Prefixes are made distinct before they meet, so a first turn that opens a third of all conversations is one row.
    """
    h = prefix_hashes(turns, conv, turn, role, text)
    keys = h.select(conv, "__block", "n", "h1", "h2", "last")
    whole = (
        keys.where("last").groupBy("n", "h1", "h2")
        .agg(F.min(F.struct(F.col(conv).isNotNull().alias("some"), F.col(conv).alias("id"))).alias("__w"))
        .select("n", "h1", "h2", F.col("__w.id").alias("__id"))
    )
    proper = keys.where(~F.col("last")).select("n", "h1", "h2").distinct()
    maximal = whole.join(proper, ["n", "h1", "h2"], "left_anti").select("__id", F.col("n").alias("n_turns"))
    blocks = keys.select(F.col(conv).alias("__bc"), F.col("__block").alias("__bb")).distinct()
    kept = maximal.join(blocks, F.col("__id").eqNullSafe(F.col("__bc"))).select("__bc", "__bb", "n_turns")
    return h.join(kept, F.col(conv).eqNullSafe(F.col("__bc")) & (F.col("__block") == F.col("__bb"))).select(conv, turn, role, text, "n", "n_turns")


def render(turns: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """conv, n_turns, part and rendered from :func:`collapse`: ``<|role|>``, the text and ``<|end|>`` for each turn.

    A conversation is rendered in parts of at most ``BLOCK`` turns, so no group is unbounded; those with up to ``BLOCK``
    turns have one part, 0. Concatenated by part, they are the conversation. A null role is "unknown", a null text "".
    """
    piece = F.concat(
        F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n")
    )
    return (
        turns.select(F.col(conv), "n_turns", F.floor((F.col("n") - 1) / BLOCK).cast("int").alias("part"), "n", piece.alias("__p"))
        .groupBy(conv, "n_turns", "part")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "__p"))), lambda s: s["__p"]), "").alias("rendered"))
    )
