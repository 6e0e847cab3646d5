"""Evaluation of extracted records against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import checkpointed

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normalized(text: Column) -> Column:
    return F.trim(F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, ""))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(pairs: DataFrame, by: list[str], predicted: Column, true: Column) -> DataFrame:
    """Counts, precision, recall and F1 of two boolean columns."""
    counts = pairs.groupBy(*by).agg(F.count_if(predicted & true).alias("tp"), F.count_if(predicted & ~true).alias("fp"), F.count_if(~predicted & true).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(*by, "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def close(predicted: Column, true: Column) -> Column:
    """Within 1 % of the truth, or 0.01 where the truth is 0."""
    return F.when(true == 0, F.abs(predicted) <= 0.01).otherwise(F.abs(predicted - true) <= F.abs(true) * 0.01)


def name_score(predicted: Column, true: Column) -> Column:
    """1 where one normalised text holds the other, 0.5 where they share half of the shorter one's words, else 0."""
    a, b = normalized(predicted), normalized(true)
    words = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0)))
    shared = F.size(F.array_intersect(words(a), words(b))) * 2 >= F.least(F.size(words(a)), F.size(words(b)))
    return F.when(F.contains(a, b) | F.contains(b, a), 1.0).when(shared, 0.5).otherwise(0.0)


def field_score(predicted, true) -> Column:
    """The mean of three fields of a pair of records: the name's score, and equal normalised category and unit.

    ``predicted`` and ``true`` are functions that give a record's field by name: name, category or unit.
    """
    same = lambda f: F.when(normalized(predicted(f)) == normalized(true(f)), 1.0).otherwise(0.0)
    return (name_score(predicted("name"), true("name")) + same("category") + same("unit")) / 3


def first_by_name(predictions: DataFrame, truth: DataFrame, file: str, place: str) -> DataFrame:
    """Each true record with the first prediction of its file whose normalised name is the same."""
    w = Window.partitionBy(file, "__n").orderBy(place)
    first = predictions.withColumn("__n", normalized(F.col("name"))).withColumn("__r", F.row_number().over(w)).where("__r = 1")
    first = first.select(F.col(file).alias("__f"), F.col("__n").alias("__k"), F.col("value").alias("predicted"), F.lit(True).alias("found"))
    rows = truth.withColumn("__n", normalized(F.col("name")))
    return rows.join(first, (F.col(file) == F.col("__f")) & (F.col("__n") == F.col("__k")), "left").drop("__f", "__k", "__n")


def positions(rows: DataFrame, key: str) -> DataFrame:
    """Each distinct ``key`` with its place from 0 in ascending order. Keys are dealt by range; only ranges' counts meet."""
    keys = checkpointed(rows.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = keys.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return keys.join(bases, "__range").select(key, (F.col("__base") + within).alias("position"))


def zipped(predictions: DataFrame, truth: DataFrame, task: int = 500_000) -> DataFrame:
    """One row: files, em, numbers, right, num_acc, grounded and grounding, of records compared file by file.

    Files are paired by their places, the first predicted with the first true one, whatever their names; those beyond the
    shorter side count for ``files`` (of predictions) alone. Records have file, place, flow_name, category, unit, value
    and chunk_id. ``em`` is the mean share of a true file's texts among the predicted ones; a true record is compared
    with the first predicted one of its name. Both sides' rows are dealt into a task for about every ``task`` of them, by
    place and text or name, so that both meet in one grouping and a task's memory does not grow with the rows.
    """
    parts = max(int(predictions.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(predictions.count() + truth.count()) // task))

    def placed(rows: DataFrame, true: bool) -> DataFrame:
        at = positions(rows, "file").withColumnRenamed("file", "__f")
        named = rows.withColumn("__n", normalized(F.col("flow_name"))).repartition(parts, "file").join(at, F.col("file") == F.col("__f"))
        texts = F.array_compact(F.array("__n", *[F.when(F.col(c).isNotNull(), normalized(F.col(c))) for c in ("category", "unit")]))
        return named.select("position", F.lit(true).alias("__true"), "place", "__n", texts.alias("texts"), "value", "chunk_id")

    p, t = placed(predictions, False), placed(truth, True)
    both = p.unionByName(t)
    texts = both.select("position", "__true", F.explode(F.array_distinct("texts")).alias("text")).repartition(parts, "position", "text")
    texts = texts.groupBy("position", "text").agg(F.max("__true").alias("t"), F.max(~F.col("__true")).alias("p"))
    shared = texts.groupBy("position").agg(F.try_divide(F.count_if(F.col("t") & F.col("p")), F.count_if("t")).alias("recall"), F.max("p").alias("p")).where("p AND recall IS NOT NULL")
    n = predictions.select("file").where("file IS NOT NULL").distinct().agg(F.count("*").alias("files"))
    em = shared.agg(F.coalesce(F.sum("recall"), F.lit(0.0)).alias("__recall"))
    guess = lambda c: F.when(~F.col("__true"), c)
    first = F.min_by(guess(F.struct("value", "chunk_id")), guess(F.col("place"))).over(Window.partitionBy("position", "__n"))
    pairs = both.drop("texts").repartition(parts, "position", "__n").withColumn("__m", first).where("__true AND value IS NOT NULL AND __m.value IS NOT NULL")
    right = close(F.col("__m.value"), F.col("value"))
    counts = pairs.agg(F.count("*").alias("numbers"), F.count_if(right).alias("right"), F.count_if(right & F.col("chunk_id").eqNullSafe(F.col("__m.chunk_id"))).alias("grounded"))
    return n.join(em).join(counts).select(
        "files", F.round(ratio(F.col("__recall"), F.col("files")), 6).alias("em"), "numbers", "right", F.round(ratio(F.col("right"), F.col("numbers")), 6).alias("num_acc"),
        "grounded", F.round(ratio(F.col("grounded"), F.col("right")), 6).alias("grounding"),
    )
