"""Words and tables on a page: boxes and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap(x0: Column, top: Column, x1: Column, bottom: Column, ax0: Column, atop: Column, ax1: Column, abottom: Column) -> Column:
    """The area that two boxes share."""
    zero = F.lit(0)
    return F.greatest(zero, F.least(x1, ax1) - F.greatest(x0, ax0)) * F.greatest(zero, F.least(bottom, abottom) - F.greatest(top, atop))


def outside(words: DataFrame, tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Words of which no table of their page covers ``share``: an anti-join on the page, then on the boxes."""
    t = tables.select(F.col("page").alias("__p"), *[F.col(c).alias(f"__{c}") for c in ("x0", "top", "x1", "bottom")])
    c = F.col
    area = (c("x1") - c("x0")) * (c("bottom") - c("top"))
    shared = overlap(c("x0"), c("top"), c("x1"), c("bottom"), c("__x0"), c("__top"), c("__x1"), c("__bottom"))
    return words.join(t, (c("page") == c("__p")) & (shared >= share * area), "left_anti")


def lines(words: DataFrame, height: float = 7.2) -> DataFrame:
    """Words of each page as lines: a word over ``height`` below its line's first word begins a new one."""
    ordered = F.array_sort(F.collect_list(F.struct("top", "x0", "word")))
    one = lambda w: F.struct(w["top"].alias("top"), F.array(w["word"]).alias("words"))
    kind = "array<struct<top:double,words:array<string>>>"

    def step(done: Column, w: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["top"].alias("top"), F.concat(last["words"], F.array(w["word"])).alias("words"))
        begins = F.size(done) == 0
        return F.when(begins | (F.abs(w["top"] - last["top"]) > height), F.concat(done, F.array(one(w)))).otherwise(
            F.concat(F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1)), F.array(longer))
        ).cast(kind)

    pages = words.groupBy("page").agg(F.aggregate(ordered, F.array().cast(kind), step).alias("l"))
    return pages.select("page", F.posexplode("l").alias("line", "x")).select("page", "line", F.array_join("x.words", " ").alias("text"))
