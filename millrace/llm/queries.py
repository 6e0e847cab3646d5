"""One query for each training-data operator, with production parameters over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat_collapse, decontamination, fim, licenses, matroska, near_dedup, packing, quality, sharding, substring_dedup, token_store, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n
  FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
  )
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, i, n, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s FROM words
  ) WHERE i <= greatest(n - 2, 1)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT c.a, c.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
  ) c JOIN sizes p ON p.doc_id = c.a JOIN sizes q ON q.doc_id = c.b
  WHERE 100 * c.both >= 85 * (p.n + q.n - c.both)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(table(spark, sf_dir, "documents"))


def op3_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.render(chat_collapse.collapse(table(spark, sf_dir, "conversations")))


OP3_SQL = """
WITH c AS (
  SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn, role, text) AS l
  FROM conversations GROUP BY conv_id
), kept AS (
  SELECT a.conv_id, a.l FROM c a
  WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.l[1] = a.l[1] AND len(b.l) > len(a.l) AND b.l[1:len(a.l)] = a.l)
    AND NOT EXISTS (SELECT 1 FROM c b WHERE b.l[1] = a.l[1] AND b.l = a.l AND b.conv_id < a.conv_id)
)
SELECT conv_id, CAST(len(l) AS BIGINT) AS n_turns, CAST(0 AS INTEGER) AS part,
  array_to_string(list_transform(l, lambda s: '<|' || s.r || '|>' || chr(10) || s.x || chr(10) || '<|end|>' || chr(10)), '') AS rendered
FROM kept
"""



def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_store(spark, store)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
), windows AS (
  SELECT doc_id, i, w, CASE WHEN count(*) OVER next35 = 35 THEN md5(string_agg(w, ' ') OVER next35) END AS h
  FROM words WINDOW next35 AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), again AS (SELECT h FROM windows WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
judged AS (
  SELECT doc_id, i, w, max(found) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM (SELECT w.doc_id, w.i, w.w, CASE WHEN a.h IS NULL THEN 0 ELSE 1 END AS found FROM windows w LEFT JOIN again a ON a.h = w.h)
), done AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone = 1) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (gone = 0) AS kept
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(x.n_words, 0) AS n_words, coalesce(x.n_removed, 0) AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done x ON x.doc_id = d.doc_id
"""

SHARDS = 24


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_records(
        table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * SHARDS, grown=[1.0] * (SHARDS + 1)
    )
    return placed.withColumn("law", F.lit("key")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")




def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from rows that are not held out."""
    sample = toxicity.labelled_sample(docs, labels.where(~toxicity.held_out()), label="toxic")
    return toxicity.fit(sample, label="label", text="text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "hits", "n_words"
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(table(spark, sf_dir, "documents"), seed=1))


OP11_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), numbered AS (
  SELECT doc_id, t, n, CAST('0x' || s[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || s[9:16] AS BIGINT) % (n + 1) AS c2,
    CAST('0x' || s[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || s[25:32] AS BIGINT) % 100 AS h4 FROM hashed
), parted AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
    substring(t, 1, least(c1, c2)) AS p, substring(t, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS m, substring(t, greatest(c1, c2) + 1) AS s FROM numbered
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parted
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Learned from rows that are not held out."""
    return quality.fit(quality.labelled_sample(docs, labels.where(~quality.held_out()), label="quality"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_matroska": op2_matroska,
    "op3_chat_collapse": op3_chat_collapse,
    "op4_packing": op4_packing,
    "op5_token_store": op5_token_store,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_licenses": op10_licenses,
    "op11_fim": op11_fim,
    "op12_whitening": op12_whitening,
    "op13_quality": op13_quality,
}
ORACLE = {"op1_near_dedup": OP1_SQL, "op3_chat_collapse": OP3_SQL, "op6_substring_dedup": OP6_SQL, "op11_fim": OP11_SQL}
