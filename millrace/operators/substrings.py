"""Which names hold which strings, found through an index of character grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a gram; shorter strings are looked up by grams of their own length.
GRAM = 3
#: Posting lists that are intersected for each string: the shortest ones.
LISTS = 2


def grams(text: Column, size: Column) -> Column:
    """The distinct grams of ``size`` characters of a text; none where it is shorter."""
    last = F.length(text) - size + 1
    return F.array_distinct(F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, size))).otherwise(F.array().cast("array<string>")))


def holders(needles: DataFrame, names: DataFrame, lists: int = LISTS) -> DataFrame:
    """(needle, name): every name that holds a needle, of the distinct values of ``needles`` (needle) and ``names`` (name).

    A name that holds a needle holds all of its grams. Each needle takes its ``lists`` rarest grams, the names that stand
    under all of them are its candidates, and ``contains`` verifies these. So a needle meets the names of its rarest grams
    and no others; nothing is compared with everything. A needle with a gram that no name has needs no look-up at all.
    Null and empty needles and names have no rows. Letters are compared as they are.
    """
    asked = needles.select("needle").where(F.length("needle") > 0).distinct()
    sizes = F.least(F.length("needle"), F.lit(GRAM))
    wanted = asked.select("needle", F.explode(grams(F.col("needle"), sizes)).alias("gram"))
    known = names.select("name").where(F.length("name") > 0).distinct()
    every = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: grams(F.col("name"), n))))
    postings = known.select("name", F.explode(every).alias("__gram"))
    postings = postings.join(wanted.select(F.col("gram").alias("__gram")).distinct(), "__gram", "left_semi")
    lengths = postings.groupBy("__gram").agg(F.count("*").alias("__n"))
    order = Window.partitionBy("needle").orderBy("__n", "gram")
    rated = wanted.join(lengths, F.col("gram") == F.col("__gram"), "left")
    rated = rated.withColumn("__k", F.row_number().over(order)).withColumn("__lost", F.max(F.col("__n").isNull()).over(Window.partitionBy("needle")))
    chosen = rated.where(~F.col("__lost") & (F.col("__k") <= lists)).select("needle", F.col("gram").alias("__g"), F.least(F.size(grams(F.col("needle"), sizes)), F.lit(lists)).alias("__of"))
    met = postings.join(chosen, F.col("__gram") == F.col("__g")).groupBy("needle", "name", "__of").agg(F.count("*").alias("__met"))
    return met.where((F.col("__met") == F.col("__of")) & F.contains("name", "needle")).select("needle", "name")
