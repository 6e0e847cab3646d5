"""A corpus pipeline: toxicity, near copies, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and all rows that its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, near_dedup, packing, substring_dedup, toxicity
from millrace.llm.queries import table, toxicity_model
from millrace.llm.shared import drop_staged, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3. The lexicon learns from labelled documents that are not held out."""
    return toxicity.without_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares at least 0.8 of its shingles of five words."""
    return near_dedup.one_of_each(docs, shingle=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that stand in several places."""
    return substring_dedup.cut_repeats(docs, width=50).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within a tenth of its words."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack),
]

#: SQL can express neither the learned lexicon nor the tokenizer; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop_staged(last)
        last = docs
    return docs
