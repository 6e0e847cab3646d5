"""Connected components of edge tables by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import drop_staged, staged


def components(edges: DataFrame) -> DataFrame:
    """Staged node, label for every node of ``edges`` (a long, b long): the same label within a component only.

    Each round every node points to its least neighbour, if that is less than itself, and edges are drawn anew between
    what their ends point to; loops and repeats go. At least half of the nodes that still have edges go each round. Only
    minima are gathered by node, so a node with very many edges is one row of each task. Null ends are dropped.
    """
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("__m")).select(F.col("a").alias("__n"), F.least("a", "__m").alias("__to"))
        to = staged(to, "pointers")
        if labels is None:
            labels = to.select(F.col("__n").alias("node"), F.col("__to").alias("label"))
            old = [to]
        else:
            new = labels.join(to, labels["label"] == to["__n"], "left").select("node", F.coalesce("__to", "label").alias("label"))
            labels = staged(new, "labels")
            drop_staged(*old)
            old = [labels, to]
        ends = edges.join(to, edges["a"] == to["__n"]).select(F.col("__to").alias("__a"), "b")
        ends = ends.join(to, ends["b"] == to["__n"]).select("__a", F.col("__to").alias("__b")).where("__a <> __b")
        left = staged(ends.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).distinct(), "edges")
        drop_staged(edges)
        edges = left
        if edges.isEmpty():
            return labels
