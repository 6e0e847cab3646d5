"""Sources and sinks: JSON lists and lines, text files, base64 payloads, partitioned documents, keyed rewrites."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset and driver and tasks are one process (a local master, as in tests), a local one; else an error,
    as executors would write to folders that nobody else can read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path for a sink or a temporary collection."""
    return f"{shared_folder(spark)}/sinks/{uuid.uuid4().hex}-{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that further rounds start from files and survive lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files that hold one object or a list of objects each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_lists(rows: DataFrame, path: str, per_file: int = 20_000) -> None:
    """Files that hold a JSON list of about ``per_file`` rows each, however many rows there are and whatever they hold."""
    files = max(1, -(-rows.count() // per_file))
    dealt = rows.select(F.struct("*").alias("row"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files)).alias("file"))
    dealt.groupBy("file").agg(F.to_json(F.collect_list("row")).alias("value")).write.partitionBy("file").text(path)


def read_tagged(spark: SparkSession, path: str, schema: str, pattern: str = "*.json*") -> DataFrame:
    """JSON lines below a folder, at any depth, with ``kind``: the name of the folder they lie in, or the value it was partitioned by."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    return rows.withColumn("kind", F.url_decode(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -2), "^kind=", "")))


def read_texts(spark: SparkSession, path: str, without: str = r"(mapping|log)\.[a-z]+$") -> DataFrame:
    """Whole text files but those whose names match ``without``: name, text."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return rows.select(name.alias("name"), F.col("value").alias("text")).where(~F.rlike("name", F.lit(without)))


def papers(rows: DataFrame) -> DataFrame:
    """One row for each paper that has data, from records with a list of papers."""
    return rows.select(F.explode("papers").alias("p")).select("p.*").where("lci_data IS NOT NULL")


def decoded(payload: Column) -> Column:
    """The text of a base64 payload."""
    return F.unbase64(payload).cast("string")


def build_collection(vectors: DataFrame, path: str) -> None:
    """A temporary vector collection (vec_id, v) as files that every task can read."""
    vectors.write.mode("overwrite").parquet(path)


def append(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("append").partitionBy(*by).parquet(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """JSON lines by difficulty and document type."""
    rows.write.mode("overwrite").partitionBy("difficulty", "doc_type").json(path)


def write_samples(rows: DataFrame, path: str) -> None:
    """Train and eval samples as JSON lines in a folder each, by ``part``."""
    rows.write.mode("overwrite").partitionBy("part").json(path)


def rewrite_sessions(spark: SparkSession, path: str, new: DataFrame, key: str = "session_id") -> None:
    """Replaces the partitions of the sessions in ``new`` and leaves all others: the table is partitioned by ``key``."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
