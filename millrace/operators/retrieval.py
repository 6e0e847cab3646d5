"""Chunk and catalog search: lexical scores, boosts, fusion, keyword and hash embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reranker and of query keywords.
COVERAGE, DENSITY, TABLE = 0.15, 0.12, 0.18
STOP_WORDS = ("的", "是", "在", "有", "和", "与", "或", "但", "而", "了", "着", "过")


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def keywords(query: Column) -> Column:
    """Words of a query, as they are, with more than one character that are no stop words, in order."""
    stops = F.array(*[F.lit(s) for s in STOP_WORDS])
    found = F.regexp_extract_all(query, F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~F.array_contains(stops, w))


def query_terms(query: Column) -> Column:
    """Distinct lower-case terms of a query or of several, joined by ``|``."""
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(query, r"\|", " ")), " +"), lambda w: w != ""))


def coverage_boost(content: Column, terms: Column) -> Column:
    hit = F.size(F.filter(terms, lambda t: F.contains(F.lower(content), t)))
    return F.when(F.size(terms) > 0, hit / F.size(terms) * COVERAGE).otherwise(0.0)


def numbers(content: Column) -> Column:
    """Numbers in a text but years from 1900 to 2100."""
    found = F.transform(F.regexp_extract_all(content, F.lit(r"([0-9]+\.?[0-9]*)"), F.lit(1)), lambda n: n.try_cast("double"))
    return F.filter(found, lambda n: ~n.between(1900, 2100))


def pipes(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("|"), F.lit("")))


def density_boost(content: Column) -> Column:
    return F.least(F.size(numbers(content)) / 5.0, F.lit(1.0)) * DENSITY


def table_boost(content: Column) -> Column:
    return F.when(pipes(content) >= 3, TABLE).otherwise(0.0)


def search(chunks: DataFrame, queries: list[str], *, least: float = 0.3, per_query: int = 3, total: int = 10, distinct: bool = True) -> DataFrame:
    """Reranked chunks of one or several queries: chunk_key, query_no, similarity, boosted, rank.

    For each query the best 2 * ``per_query`` chunks, of these the ones from ``least`` on, of these ``per_query``; over
    all queries the best hit of each chunk (or all, if not ``distinct``), boosted by coverage, density and tables; of
    these ``total``. Each limit is a top-k that tasks apply to their own rows first.
    """
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("query_no"), query_terms(F.lit(q.lower())).alias("terms")) for i, q in enumerate(queries)]))
    every = query_terms(F.lit("|".join(queries).lower()))
    rows = chunks.withColumn("__w", F.array_intersect(every, words(F.col("content")))).where(F.size("__w") > 0)  # the words once, for all queries
    rows = rows.withColumn("__q", asked).select("*", "__q.query_no", "__q.terms").drop("__q")
    share = F.size(F.array_intersect("terms", "__w")) / F.greatest(F.size("terms"), F.lit(1))
    rows = rows.withColumn("similarity", F.round(share, 6)).where("similarity > 0").drop("__w", "terms")
    over = Window.partitionBy("query_no").orderBy(F.desc("similarity"), "chunk_key")
    best = rows.withColumn("__r", F.row_number().over(over)).where(F.col("__r") <= 2 * per_query).where(F.col("similarity") >= least)
    best = best.withColumn("__r", F.row_number().over(over)).where(F.col("__r") <= per_query).drop("__r")
    if distinct:
        one = Window.partitionBy("chunk_key").orderBy(F.desc("similarity"), "query_no")
        best = best.withColumn("__r", F.row_number().over(one)).where("__r = 1").drop("__r")
    terms = query_terms(F.lit("|".join(queries)))
    boost = coverage_boost(F.col("content"), terms) + density_boost(F.col("content")) + table_boost(F.col("content"))
    best = best.withColumn("boosted", F.round(F.col("similarity") + boost, 6)).orderBy(F.desc("boosted"), "chunk_key", "query_no").limit(total)
    return best.select("chunk_key", "chunk_id", "query_no", "similarity", "boosted")


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """Vector and keyword hits of each query as one list by uuid; a vector hit wins; those without a score come last."""
    none = F.lit(None).cast("double")
    both = vector_hits.select(by, "uuid", F.lit(0).alias("source"), "score").unionByName(keyword_hits.select(by, "uuid", F.lit(1).alias("source"), none.alias("score")))
    one = both.where("uuid IS NOT NULL").groupBy(by, "uuid").agg(F.min(F.struct("source", "score")).alias("__h")).select(by, "uuid", "__h.source", F.coalesce("__h.score", F.lit(0.0)).alias("score"))
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "source", "uuid"))
    return one.withColumn("__r", best).where(F.col("__r") <= k).drop("__r")


# Hits of each branch, and of all.
TEXT_HITS, OTHER_HITS, ALL_HITS = 5, 3, 10


def relevance(text: Column, query: str) -> Column:
    """How well a name answers a query: how many of the query's words it has."""
    asked = F.array(*[F.lit(q) for q in dict.fromkeys(query.lower().split())])
    return F.size(F.array_intersect(asked, words(text)))


def catalog_keyword_hits(catalog: DataFrame, term: str) -> DataFrame:
    """Text, category and product hits of a term, in this order, each branch limited; the first of each uuid; ten of all.

    Text hits have a word of the query in their name and come by relevance; the others hold the query. Equally good hits
    come by their names' lengths, then by uuid.
    """
    t, score = F.lit(term.lower()), relevance(F.col("name"), term)
    branches = (
        ("text", score > 0, score, TEXT_HITS), ("category", F.exists("categories", lambda c: F.contains(F.lower(c), t)), F.lit(0), OTHER_HITS),
        ("product", F.contains(F.lower("reference_product"), t), F.lit(0), OTHER_HITS),
    )
    rows, order = None, (F.desc("score"), "len", "uuid")
    for no, (name, hit, by, n) in enumerate(branches):
        some = catalog.where(hit).select("uuid", F.lit(no).alias("branch"), F.lit(name).alias("found_in"), by.alias("score"), F.length("name").alias("len")).orderBy(*order).limit(n)
        rows = some if rows is None else rows.unionByName(some)
    first = rows.groupBy("uuid").agg(F.min(F.struct("branch", "found_in", "score", "len")).alias("h")).select("uuid", "h.*")
    return first.orderBy("branch", *order).limit(ALL_HITS).select("uuid", "found_in", "score")


def hash_embedding(text: Column, dims: int = 384) -> Column:
    """A deterministic vector from the bytes of the text's md5, each divided by 255, repeated over ``dims``."""
    byte = lambda digest, i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255
    once = F.transform(F.array(F.md5(text.cast("binary"))), lambda digest: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: byte(digest, i)))
    return F.slice(F.flatten(F.flatten(F.array_repeat(once, -(-dims // 16)))), 1, dims)


def digest(text: Column) -> Column:
    """The 16 bytes that :func:`hash_embedding` is made from."""
    return F.unhex(F.md5(text.cast("binary")))


def digest_vectors(digests: pa.Array, dims: int) -> np.ndarray:
    """Vectors of 16 entries whose cosines are those of the :func:`hash_embedding` of ``dims`` entries that repeat them."""
    entries = np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 16) / 255
    return entries * np.sqrt(np.bincount(np.arange(dims) % 16, minlength=16))


def backfill(rows: DataFrame, dims: int) -> DataFrame:
    """Vectors for rows that have none."""
    return rows.withColumn("vector", F.coalesce("vector", hash_embedding(F.col("text"), dims)))


def relevant_sentences(content: Column, query: Column) -> Column:
    """struct(content, confidence): the two sentences that share most words with the query."""
    asked = F.array_distinct(F.split(F.lower(query), " +"))
    sentences = F.filter(F.transform(F.split(content, r"[.!?。！？][ \t\n]*"), lambda x: F.trim(x)), lambda s: F.length(s) > 10)
    score = lambda s: F.size(F.array_intersect(asked, F.split(F.lower(s), "[ \t\n]+"))) / F.size(asked)
    none = F.struct(F.concat(F.substring(content, 1, 200), F.lit("...")).alias("content"), F.lit(0.3).alias("confidence"))

    def chosen(sentences: Column) -> Column:
        scored = F.transform(sentences, lambda s, i: F.struct((-score(s)).alias("minus"), i.alias("i"), s.alias("s")))
        hits = F.slice(F.array_sort(F.filter(scored, lambda r: r["minus"] < 0)), 1, 2)
        first = F.struct(F.array_join(F.slice(sentences, 1, 2), ". ").alias("content"), F.lit(0.2).alias("confidence"))
        return F.when(F.size(sentences) == 0, none).otherwise(_with(hits, lambda h: F.when(F.size(h) == 0, first).otherwise(found(h))))

    def found(hits: Column) -> Column:
        return F.struct(F.array_join(F.transform(hits, lambda r: r["s"]), " ").alias("content"), F.least(F.lit(0.9), -F.array_min(F.transform(hits, lambda r: r["minus"]))).alias("confidence"))

    return _with(sentences, chosen)


def sentences(text: Column) -> Column:
    """Parts of a text between full stops of Chinese, and lines; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "[。！？；\n]"), lambda x: F.trim(x)), lambda s: s != "")


def key_information(content: Column, query: Column) -> Column:
    """The first three sentences with a keyword of the query, else the first 100 characters, with dots where there are more."""
    asked = F.transform(keywords(query), lambda k: F.lower(k))
    hits = F.slice(F.filter(sentences(content), lambda s: F.exists(asked, lambda k: F.contains(F.lower(s), k))), 1, 3)
    start = F.concat(F.substring(content, 1, 100), F.when(F.length(content) > 100, "...").otherwise(""))
    return F.when(F.size(hits) > 0, F.array_join(hits, " ")).otherwise(start)


# Items of lists, numbered items, and sentences about methods and results. A sentence is tried from its
# beginning alone and an item from its own line, so each text is read once however long its sentences and blank lines are.
POINTS = (
    r"(?im)^[ \t\x0B\f]*+[-•]\s*(.+)", r"(?im)^[ \t\x0B\f]*+[0-9]++[.)]\s*(.+)",
    r"(?i)(?<![^.!?])[^.!?a-z]*+([a-z](?>[^.!?]*?(?:method|approach|process|result|conclusion))[^.!?]*+[.!?])",
)


def _with(value: Column, made) -> Column:
    """``made`` of a value that is made once for each row, as the one entry of an array."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def key_points(content: Column, query: Column) -> Column:
    """struct(content, confidence): the first three points of a text as a list.

    Points are list items, numbered items and sentences about methods and results; without any, sentences that share a
    word with the query; without any of these, what :func:`relevant_sentences` gives.
    """
    marked = F.slice(F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in POINTS]), 1, 3)
    asked = F.array_distinct(F.split(F.lower(F.trim(query)), r"\s+"))
    parts = F.split(content, r"[.!?。！？]\s*")
    shared = F.transform(F.filter(parts, lambda s: F.arrays_overlap(asked, F.split(F.lower(F.trim(s)), r"\s+"))), lambda s: F.trim(s))
    points = _with(marked, lambda m: F.when(F.size(m) > 0, m).otherwise(F.slice(shared, 1, 3)))
    listed = lambda ps: F.struct(F.concat(F.lit("• "), F.array_join(ps, "\n• ")).alias("content"), F.lit(0.7).alias("confidence"))
    return _with(points, lambda ps: F.when(F.size(ps) > 0, listed(ps)).otherwise(relevant_sentences(content, query)))


def extracted(hits: DataFrame, query: str, mode: str = "chunks", content: str = "content", score: str = "similarity") -> DataFrame:
    """Adds extracted_content, confidence and extract_type to search hits: whole chunks, sentences or key points."""
    if mode == "chunks":
        return hits.withColumns({"extracted_content": F.col(content), "confidence": F.col(score), "extract_type": F.lit("chunk")})
    of = relevant_sentences if mode == "sentences" else key_points
    rows = hits.withColumn("__e", of(F.col(content), F.lit(query)))
    return rows.withColumns({"extracted_content": F.col("__e.content"), "confidence": F.col("__e.confidence"), "extract_type": F.lit(mode)}).drop("__e")
