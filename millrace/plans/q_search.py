"""Search, chunk and text-feature queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import retrieval as R
from millrace.operators import text_features as T
from millrace.operators.matching import similarity_of_distance
from millrace.operators.vectors import nearest
from millrace.plans import views as V
from millrace.plans.q_matching import _VEC, _vectors

QUERIES: dict = {}
ORACLE: dict = {}
C = F.col


def add(name, sql):
    def deco(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return deco


ASKED = ["the of that", "ar la el", "machine energy the"]
_KEYED = "lpad(CAST(doc_id AS VARCHAR), 9, '0') || '-' || lpad(CAST(chunk_index AS VARCHAR), 6, '0')"


def _keyed(spark, sf):
    return V.chunks(spark, sf).withColumn("chunk_key", F.concat(F.lpad(C("doc_id").cast("string"), 9, "0"), F.lit("-"), F.lpad(C("chunk_index").cast("string"), 6, "0")))


def _terms(q):
    return "[" + ",".join(f"'{t}'" for t in dict.fromkeys(q.lower().replace("|", " ").split())) + "]"


_WORDS = r"list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+'))"
_NUMS = r"len(list_filter(regexp_extract_all(content, '[0-9]+\.?[0-9]*'), lambda n: NOT (CAST(n AS DOUBLE) BETWEEN 1900 AND 2100)))"


def _boost(queries):
    t = _terms("|".join(queries))
    return f"""len(list_filter({t}, lambda t: contains(lower(content), t))) / len({t}) * 0.15::DOUBLE + least({_NUMS} / 5.0::DOUBLE, 1.0) * 0.12::DOUBLE
  + CASE WHEN length(content) - length(replace(content, '|', '')) >= 3 THEN 0.18::DOUBLE ELSE 0 END"""


def _search_ctes(queries, distinct=True):
    """Common table expressions of a search; its result is ``found``."""
    sims = " UNION ALL ".join(
        f"SELECT {i} AS query_no, chunk_key, chunk_id, content, round(len(list_intersect({_terms(q)}, ws)) / {len(dict.fromkeys(q.split()))}::DOUBLE, 6) AS similarity FROM s0" for i, q in enumerate(queries)
    )
    return f"""{V.CHUNKS}, s0 AS (SELECT *, {_KEYED} AS chunk_key, {_WORDS} AS ws FROM v_chunks), s1 AS (SELECT * FROM ({sims}) WHERE similarity > 0),
s2 AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY similarity DESC, chunk_key) AS r FROM s1),
s3 AS (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY query_no ORDER BY similarity DESC, chunk_key) AS r FROM s2 WHERE r <= 6 AND similarity >= 0.3),
s4 AS (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY chunk_key ORDER BY similarity DESC, query_no) AS r FROM s3 WHERE r <= 3),
found AS (SELECT chunk_key, chunk_id, query_no, similarity, round(similarity + {_boost(queries)}, 6) AS boosted FROM s4 {'WHERE r = 1' if distinct else ''} ORDER BY boosted DESC, chunk_key, query_no LIMIT 10)"""


def _search_sql(queries, distinct=True):
    return f"WITH {_search_ctes(queries, distinct)} SELECT * FROM found"


@add("document_search_single", _search_sql(ASKED[:1]))
def _(spark, sf):
    return R.search(_keyed(spark, sf), ASKED[:1])


@add("document_search_multi", _search_sql(ASKED))
def _(spark, sf):
    return R.search(_keyed(spark, sf), ASKED)


@add("document_search_nodedup", _search_sql(ASKED, False))
def _(spark, sf):
    return R.search(_keyed(spark, sf), ASKED, distinct=False)


@add("boost_components", f"""WITH {V.TEXTS}, x AS (SELECT *, text AS content FROM v_text) SELECT l_partkey % 4 AS kind, {_NUMS} AS numbers, length(content) - length(replace(content, '|', '')) AS pipes,
  round({_boost(['steel energy', 'argon|kwh'])}, 6) AS boost, count(*) AS n FROM x GROUP BY ALL""")
def _(spark, sf):
    t, terms = C("text"), R.query_terms(F.lit("steel energy|argon|kwh"))
    boost = R.coverage_boost(t, terms) + R.density_boost(t) + R.table_boost(t)
    rows = V.texts(spark, sf).select((C("l_partkey") % 4).alias("kind"), F.size(R.numbers(t)).cast("long").alias("numbers"), R.pipes(t).cast("long").alias("pipes"), F.round(boost, 6).alias("boost"))
    return rows.groupBy("kind", "numbers", "pipes", "boost").agg(F.count("*").alias("n"))


_PHRASE = "small"
_KW = """rel AS (SELECT uuid, length(name) AS len, CASE WHEN list_contains(regexp_extract_all(lower(name), '[\\p{L}\\p{N}_]+'), 'small') THEN 1 ELSE 0 END AS score FROM v_catalog),
  b AS ((SELECT uuid, 0 AS branch, 'text' AS found_in, score, len FROM rel WHERE score > 0 ORDER BY score DESC, len, uuid LIMIT 5) UNION ALL
  (SELECT uuid, 1, 'category', 0, length(name) FROM v_catalog WHERE len(list_filter(categories, lambda c: contains(lower(c), 'small'))) > 0 ORDER BY length(name), uuid LIMIT 3) UNION ALL
  (SELECT uuid, 2, 'product', 0, length(name) FROM v_catalog WHERE contains(lower(reference_product), 'small') ORDER BY length(name), uuid LIMIT 3)),
  f AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY branch) AS r FROM b), hits AS (SELECT uuid, found_in, CAST(score AS INTEGER) AS score FROM f WHERE r = 1 ORDER BY branch, score DESC, len, uuid LIMIT 10)"""


@add("catalog_keyword_search", f"WITH {V.CATALOG}, {_KW} SELECT * FROM hits")
def _(spark, sf):
    return R.catalog_keyword_hits(V.catalog(spark, sf), _PHRASE)


@add("catalog_by_category", f"WITH {V.CATALOG} SELECT uuid, name FROM v_catalog WHERE list_contains(categories, 'Brand#11') OR list_contains(categories, 'Brand#1')")
def _(spark, sf):
    return V.catalog(spark, sf).where(F.arrays_overlap("categories", F.array(F.lit("Brand#11"), F.lit("Brand#1")))).select("uuid", "name")


@add("catalog_by_location", f"WITH {V.CATALOG} SELECT uuid, name, location FROM v_catalog WHERE location = 'GLO1'")
def _(spark, sf):
    return V.catalog(spark, sf).where("location = 'GLO1'").select("uuid", "name", "location")


@add("catalog_hybrid_search", _VEC.format(eps="1e-8").replace("WITH e", f"WITH {V.CATALOG}, e") + """, v0 AS (SELECT query_id, vec_id, round(sim, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, vec_id) AS r FROM s WHERE sim >= 0.05),
  v AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS uuid, 0 AS source, score FROM v0 WHERE r <= 10), k AS (SELECT uuid FROM v_catalog WHERE contains(lower(name), 'a') ORDER BY length(name), uuid LIMIT 5),
  kq AS (SELECT vec_id AS query_id, uuid, 1 AS source, CAST(NULL AS DOUBLE) AS score FROM embeddings, k WHERE vec_id % 100 = 0), u AS (SELECT *, row_number() OVER (PARTITION BY query_id, uuid ORDER BY source) AS r FROM (SELECT * FROM v UNION ALL SELECT * FROM kq)),
  w AS (SELECT query_id, uuid, source, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0.0) DESC, source, uuid) AS p FROM u WHERE r = 1) SELECT query_id, uuid, source, score FROM w WHERE p <= 12""")
def _(spark, sf):
    q, c = _vectors(spark, sf)
    hits = nearest(q, c, 10, eps=1e-8, least=0.05, digits=6).select("query_id", C("vec_id").cast("string").alias("uuid"), "score")
    words = V.catalog(spark, sf).where(F.contains(F.lower("name"), F.lit("a"))).orderBy(F.length("name"), "uuid").limit(5)
    return R.fuse(hits, q.select("query_id").join(F.broadcast(words.select("uuid"))), 12)


@add("chunk_vector_query", _VEC.format(eps="0") + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), vec_id) AS rank FROM s) SELECT query_id, vec_id, round(CASE WHEN dist > 1 THEN 1 / (1 + dist) ELSE greatest(0.0, least(1.0, dist)) END, 6) AS similarity FROM r WHERE rank <= 4")
def _(spark, sf):
    near = nearest(*_vectors(spark, sf), 4, metric="euclid")
    return near.select("query_id", "vec_id", F.round(similarity_of_distance(C("score")), 6).alias("similarity"))


_HASH = "list_transform(generate_series(0, 15), lambda i: CAST(('0x' || md5(text)[i * 2 + 1 : i * 2 + 2]) AS INTEGER) / 255::DOUBLE)"


@add("hash_embedding", f"SELECT doc_id, round(list_sum({_HASH}), 6) AS total, round(list_extract({_HASH}, 5), 6) AS fifth FROM documents")
def _(spark, sf):
    e = R.hash_embedding(C("text"), 384)
    rows = V.table(spark, sf, "documents").select("doc_id", e.alias("e"))
    total = F.aggregate(F.slice("e", 1, 16), F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", F.round(total, 6).alias("total"), F.round(F.get("e", F.lit(4)), 6).alias("fifth"))


@add("backfill_vectors", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'kept' ELSE 'made' END AS origin, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE round(list_extract({_HASH}, 1), 6) END AS first FROM documents")
def _(spark, sf):
    had = F.when(C("doc_id") % 3 == 0, F.array(F.lit(0.5)))
    rows = R.backfill(V.table(spark, sf, "documents").select("doc_id", "text", had.alias("vector")), 16)
    return rows.select("doc_id", F.when(C("doc_id") % 3 == 0, "kept").otherwise("made").alias("origin"), F.round(F.get("vector", F.lit(0)), 6).alias("first"))


@add("query_keywords", r"""WITH w AS (SELECT item_id, list_filter(regexp_extract_all(text || ' 的 是 了', '[\p{L}\p{M}\p{N}_]+'), lambda w: length(w) > 1 AND NOT list_contains(['的', '是', '在', '有', '和', '与', '或', '但', '而', '了', '着', '过'], w)) AS k FROM benchmark)
  SELECT item_id, array_to_string(k, ' ') AS keywords, CAST(len(k) AS BIGINT) AS n FROM w""")
def _(spark, sf):
    k = R.keywords(F.concat("text", F.lit(" 的 是 了")))
    return V.table(spark, sf, "benchmark").select("item_id", F.array_join(k, " ").alias("keywords"), F.size(k).cast("long").alias("n"))


@add("relevant_sentences", None)
def _(spark, sf):
    r = R.relevant_sentences(C("text"), F.lit("the of that"))
    return V.table(spark, sf, "documents").select("doc_id", r["content"].alias("content"), F.round(r["confidence"], 6).alias("confidence"))


@add("key_information", r"""WITH s AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[。！？；\n]'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents),
  h AS (SELECT doc_id, text, list_filter(p, lambda x: contains(lower(x), 'the') OR contains(lower(x), 'thing') OR contains(lower(x), 'energy') OR contains(lower(x), 'of'))[1:3] AS p FROM s)
  SELECT doc_id, CASE WHEN len(p) > 0 THEN array_to_string(p, ' ') ELSE substring(text, 1, 100) || CASE WHEN length(text) > 100 THEN '...' ELSE '' END END AS info FROM h""")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", R.key_information(C("text"), F.lit("The thing of energy")).alias("info"))


@add("key_points", None)
def _(spark, sf):
    p = R.key_points(C("text"), F.lit("the thing of energy"))
    return V.table(spark, sf, "documents").select("doc_id", p["content"].alias("content"), F.round(p["confidence"], 6).alias("confidence"))


@add("search_endpoint", f"WITH {V.CATALOG}, {_KW}, {_search_ctes(ASKED[:1])} SELECT 'document' AS kind, chunk_key AS id, boosted AS score FROM found UNION ALL SELECT 'catalog', uuid, CAST(score AS DOUBLE) FROM hits")
def _(spark, sf):
    chunks = R.search(_keyed(spark, sf), ASKED[:1]).select(F.lit("document").alias("kind"), C("chunk_key").alias("id"), C("boosted").alias("score"))
    return chunks.unionByName(R.catalog_keyword_hits(V.catalog(spark, sf), _PHRASE).select(F.lit("catalog").alias("kind"), C("uuid").alias("id"), C("score").cast("double").alias("score")))


# --- text features -------------------------------------------------------------------------------------------------
@add("decision_features_text", None)
def _(spark, sf):
    return V.texts(spark, sf).select(*V.TEXT_KEY, T.decision_features(C("text")).alias("f")).select(*V.TEXT_KEY, "f.*")


@add("decision_features_table", None)
def _(spark, sf):
    rows = V.texts(spark, sf).withColumn("chunk_type", F.when(C("l_partkey") % 4 == 1, "table_section").when(C("l_partkey") % 8 == 2, "table_row").otherwise("text"))
    return T.chunk_features(rows).select(*V.TEXT_KEY, "chunk_type", "features.*")


@add("basis_tokens", rf"WITH {V.TEXTS} SELECT l_partkey % 4 AS kind, regexp_matches(text, '(?i)(?:\bper\s+(?:part|batch|build|unit|hour|day|tonne|kg)|/t\b|/kg\b|/h\b|each\b)') AS basis, count(*) AS n FROM v_text GROUP BY ALL")
def _(spark, sf):
    return V.texts(spark, sf).groupBy((C("l_partkey") % 4).alias("kind"), T.has_basis(C("text")).alias("basis")).agg(F.count("*").alias("n"))


def _mat(p):
    return p.replace("(?i)", "(?i)").replace("'", "''")


_ALL = " || ".join(f"regexp_extract_all(lower(text), '{_mat(p)}', 1)" for p in T.MATERIALS)
_ALLP = " || ".join(f"regexp_extract_all(text, '{_mat(p)}', 1)" for p in T.PROCESSES)


def _first(expr, n):
    return f"array_to_string(list_transform(list_filter(list_zip({expr}, generate_series(1, len({expr}))), lambda z: list_position({expr}, z[1]) = z[2])[1:{n}], lambda z: z[1]), ',')"


@add("material_keywords", f"WITH {V.TEXTS}, x AS (SELECT l_partkey % 4 AS kind, {_ALL} AS m FROM v_text) SELECT kind, {_first('m', 5)} AS materials, count(*) AS n FROM x GROUP BY ALL")
def _(spark, sf):
    return V.texts(spark, sf).groupBy((C("l_partkey") % 4).alias("kind"), F.array_join(T.materials(C("text")), ",").alias("materials")).agg(F.count("*").alias("n"))


@add("process_keywords", f"WITH {V.TEXTS}, x AS (SELECT l_partkey % 4 AS kind, {_ALLP} AS m FROM v_text) SELECT kind, {_first('m', 3)} AS processes, count(*) AS n FROM x GROUP BY ALL")
def _(spark, sf):
    return V.texts(spark, sf).groupBy((C("l_partkey") % 4).alias("kind"), F.array_join(T.processes(C("text")), ",").alias("processes")).agg(F.count("*").alias("n"))


@add("enhanced_query", f"""WITH {V.TEXTS}, x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_ALL} AS m0, {_ALLP} AS p0 FROM v_text), y AS (SELECT * EXCLUDE (m0, p0), list_concat(['Steel', 'Raw Material'], list_concat(list_filter(m0, lambda z, i: list_position(m0, z) = i)[1:5],
  list_filter(p0, lambda z, i: list_position(p0, z) = i)[1:3])) AS parts FROM x), w AS (SELECT *, list_transform(parts, lambda z: lower(z)) AS low FROM y)
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, array_to_string(list_filter(parts, lambda z, i: list_position(low, lower(z)) = i), ' ') AS query FROM w""")
def _(spark, sf):
    return V.texts(spark, sf).select(*V.TEXT_KEY, T.enhanced_query(F.lit("Steel"), F.lit("Raw Material"), C("text")).alias("query"))


_SAID = "text || CASE l_suppkey % 6 WHEN 0 THEN ' Global Warming Potential' WHEN 1 THEN ' 碳足迹' WHEN 2 THEN ' co2 的 排放' WHEN 3 THEN ' Life Cycle' ELSE '' END"
_IND = r"""[CASE WHEN regexp_matches(x, 'global warming potential|gwp|全球变暖潜值|温室气体') THEN 'GWP' END, CASE WHEN regexp_matches(x, 'cumulative energy demand|ced|累积能源需求|能源消耗') THEN 'CED' END,
  CASE WHEN regexp_matches(x, 'acidification potential|ap|酸化潜值') THEN 'AP' END, CASE WHEN regexp_matches(x, 'eutrophication potential|ep|富营养化潜值') THEN 'EP' END,
  CASE WHEN regexp_matches(x, 'photochemical ozone creation potential|pocp|光化学臭氧') THEN 'POCP' END, CASE WHEN regexp_matches(x, 'energy consumption|能源消耗|电力消耗|燃料消耗') THEN '能耗' END,
  CASE WHEN regexp_matches(x, 'carbon footprint|碳足迹|碳排放|co2.*排放') THEN '碳足迹' END, CASE WHEN regexp_matches(x, 'life cycle|lifecycle|生命周期|全生命周期') THEN '生命周期' END]"""


@add("lca_indicators", f"WITH {V.TEXTS}, y AS (SELECT l_partkey % 4 AS kind, lower({_SAID}) AS x FROM v_text) SELECT kind, array_to_string(list_filter({_IND}, lambda i: i IS NOT NULL), ',') AS indicators, count(*) AS n FROM y GROUP BY ALL")
def _(spark, sf):
    return V.texts(spark, sf).groupBy((C("l_partkey") % 4).alias("kind"), F.array_join(T.indicators(F.expr(_SAID)), ",").alias("indicators")).agg(F.count("*").alias("n"))


@add("numeric_facts", None)
def _(spark, sf):
    return V.texts(spark, sf).select(*V.TEXT_KEY, F.inline(T.numeric_facts("text")))


_TS = r"""CASE WHEN len(ls) < 3 THEN 0 ELSE CASE WHEN regexp_matches(text, '(?i)(?:Table|表格|表) *[0-9]+') THEN 3 ELSE 0 END
  + CASE WHEN len(list_filter(ls, lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= len(ls) * 0.3 THEN 2 ELSE 0 END
  + CASE WHEN len(list_filter(ls, lambda x: len(regexp_extract_all(x, '[0-9]+(?:\.[0-9]+)?')) >= 2)) >= len(ls) * 0.4 THEN 2 ELSE 0 END
  + CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '[A-Za-z0-9_]+ *[:|] *[0-9]+'))) >= 3 THEN 1 ELSE 0 END
  + CASE WHEN len(list_filter(ls, lambda x: regexp_matches(trim(x), '^[ \-|=]+$'))) >= 1 THEN 1 ELSE 0 END END"""


@add("table_heuristic", f"WITH {V.TEXTS}, a AS (SELECT text FROM v_text UNION ALL SELECT text FROM documents), x AS (SELECT text, string_split(trim(text), chr(10)) AS ls FROM a), y AS (SELECT {_TS} AS score FROM x) SELECT score, score >= 3 AS is_table, count(*) AS n FROM y GROUP BY ALL")
def _(spark, sf):
    rows = V.texts(spark, sf).select("text").unionByName(V.table(spark, sf, "documents").select("text"))
    return rows.select(T.table_score(C("text")).alias("score")).groupBy("score", (C("score") >= 3).alias("is_table")).agg(F.count("*").alias("n"))


@add("table_ui_test", f"""WITH {V.TEXTS}, x AS (SELECT l_partkey % 4 AS kind, string_split(text, chr(10)) AS ls FROM v_text) SELECT kind, len(list_filter(ls[1:3], lambda x: regexp_matches(x, '(?i)table [0-9]+'))) > 0
  OR len(list_filter(ls, lambda x: length(x) - length(replace(x, '|', '')) >= 3)) >= 2 AS is_table, count(*) AS n FROM x GROUP BY ALL""")
def _(spark, sf):
    return V.texts(spark, sf).groupBy((C("l_partkey") % 4).alias("kind"), T.looks_like_table(C("text")).alias("is_table")).agg(F.count("*").alias("n"))


_FIRST = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1]".replace("\\\\", "\\")


@add("doc_title", f"WITH f AS (SELECT doc_id, {_FIRST} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) BETWEEN 20 AND 250 AND NOT regexp_matches(t, '[.。,，;；]$') AND NOT regexp_matches(t, '(?i)^(abstract|摘要)$|^(page|第.*?页)|^(author|作者|by)\\s*:') THEN t END AS title FROM f".replace("\\\\", "\\"))
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", T.title(C("text")).alias("title"))


def _tables(spark, sf):
    return V.texts(spark, sf).where("l_partkey % 4 = 1").select(F.concat_ws("-", *V.TEXT_KEY).alias("table_id"), "text").groupBy("table_id").agg(F.min("text").alias("text"))


_CELLS = f"""WITH {V.TEXTS}, tb AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS table_id, min(text) AS text FROM v_text WHERE l_partkey % 4 = 1 GROUP BY 1),
ln AS (SELECT table_id, list_filter(string_split(text, chr(10)), lambda x: contains(x, '|') AND NOT regexp_matches(x, '^[ \\-|]+$')) AS ls FROM tb), rw AS (SELECT table_id, unnest(ls[2:]) AS line, generate_subscripts(ls[2:], 1) AS row, ls[1] AS head FROM ln),
cl AS (SELECT table_id, CAST(row AS INTEGER) AS row, trim(string_split(trim(line, '| '), '|')[i]) AS value, trim(string_split(trim(head, '| '), '|')[i]) AS header, CAST(i - 1 AS INTEGER) AS col FROM rw, (VALUES (1), (2)) v(i))""".replace("\\\\", "\\")
_KINDS = r"""kd AS (SELECT *, lower(value || chr(10) || header) AS e FROM cl WHERE value <> ''), ks AS (SELECT table_id, row, col, header, value, unnest(list_filter([CASE WHEN regexp_matches(e, '电[力耗]|energy|electricity|kwh|mj|功率|power|瓦特|watt|耗电|用电|电量|能源|能耗|消耗') THEN 'energy_consumption' END,
  CASE WHEN regexp_matches(e, '材料|material|substance|kg|ton|gram|质量|重量|原料|物料|成分|组分|投入|input') THEN 'material_flows' END, CASE WHEN regexp_matches(e, '排放|emission|co2|ghg|carbon|废气|污染|温室气体|碳排放|二氧化碳|甲烷|氧化亚氮') THEN 'emissions' END,
  CASE WHEN regexp_matches(e, '工艺|process|temperature|pressure|时间|温度|压力|参数|条件|设定|操作|运行') THEN 'process_parameters' END], lambda k: k IS NOT NULL)) AS kind FROM kd)"""


@add("table_keyvalue", _CELLS + " SELECT table_id, row, string_agg(header || ': ' || value, chr(10) ORDER BY col) AS content FROM cl WHERE value <> '' GROUP BY ALL")
def _(spark, sf):
    return T.keyvalues(T.cells(_tables(spark, sf)))


@add("table_lca_cells", _CELLS + ", " + _KINDS + r""", n AS (SELECT *, nullif(list_last(regexp_extract_all(lower(value), '([0-9]+\.?[0-9]*)\s*([a-zA-Z/]+)', 1)), '') AS num, nullif(list_last(regexp_extract_all(lower(value), '([0-9]+\.?[0-9]*)\s*([a-zA-Z/]+)', 2)), '') AS unit FROM ks)
  SELECT table_id, row, col, header, value, kind, CAST(num AS DOUBLE) AS number, unit, num || ' ' || unit AS formatted FROM n""")
def _(spark, sf):
    return T.classified(T.cells(_tables(spark, sf)))


@add("table_lca_summary", _CELLS + ", " + _KINDS + """, z AS (SELECT table_id, count(DISTINCT row) AS rows, count(DISTINCT col) AS cols FROM cl GROUP BY 1), k AS (SELECT table_id, count(*) FILTER (kind = 'energy_consumption') AS a, count(*) FILTER (kind = 'material_flows') AS b,
  count(*) FILTER (kind = 'emissions') AS c, count(*) FILTER (kind = 'process_parameters') AS d FROM ks GROUP BY 1), s AS (SELECT z.*, array_to_string(list_filter([CASE WHEN a > 0 THEN '能源消耗: ' || a || '项' END, CASE WHEN b > 0 THEN '材料流: ' || b || '项' END,
  CASE WHEN c > 0 THEN '排放: ' || c || '项' END, CASE WHEN d > 0 THEN '工艺参数: ' || d || '项' END], lambda x: x IS NOT NULL), ', ') AS l FROM z LEFT JOIN k USING (table_id))
  SELECT table_id, '表格包含' || rows || '行' || cols || '列数据' || CASE WHEN l <> '' THEN ' | LCA数据: ' || l ELSE '' END AS summary FROM s""")
def _(spark, sf):
    return T.table_summary(T.cells(_tables(spark, sf)))


@add("table_sections", f"""WITH {V.TEXTS}, x AS (SELECT l_partkey % 4 AS kind, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS ls FROM v_text WHERE l_linenumber < 8),
  y AS (SELECT kind, ls, '## ' || coalesce(list_filter(ls, lambda l: regexp_matches(l, '(?i)(?:Table|表格|表)\\s*\\d+'))[1], 'Table (Detected)') || chr(10) || chr(10) AS head FROM x)
  SELECT kind, md5(head || CASE WHEN len(list_filter(ls, lambda l: contains(l, '|'))) > 0 THEN array_to_string(ls, chr(10)) ELSE '| Parameter | Value | Unit | Description |' || chr(10) || '|-----------|-------|------|-------------|' || chr(10) ||
  array_to_string(list_transform(list_filter(ls, lambda l: NOT regexp_matches(l, '(?i)(?:Table|表格|表)\\s*\\d+')), lambda l: CASE WHEN regexp_matches(l, '^(.+?)\\s*[:|]\\s*(.+)$') THEN '| ' || trim(regexp_extract(l, '^(.+?)\\s*[:|]\\s*(.+)$', 1)) || ' | ' || trim(regexp_extract(l, '^(.+?)\\s*[:|]\\s*(.+)$', 2)) || ' | | |' || chr(10)
  ELSE '| ' || l || ' | | | |' || chr(10) END), '') END) AS md, count(*) AS n FROM y GROUP BY ALL""".replace(" WHERE l_linenumber < 8", "").replace("\\\\", "\\"))
def _(spark, sf):
    return V.texts(spark, sf).groupBy((C("l_partkey") % 4).alias("kind"), F.md5(T.text_to_markdown(C("text")).cast("binary")).alias("md")).agg(F.count("*").alias("n"))


_WIDE = "CASE WHEN l_partkey % 5 = 0 THEN 'no table' ELSE 'Table' || chr(10) || '| Part | Qty |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || l_partkey || ' | ' || l_linenumber || ' |' || CASE WHEN l_partkey % 3 = 0 THEN chr(10) || ' a | b | c | d ' ELSE '' END END"


@add("table_html", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN 'no table' ELSE '<table><thead><tr><th>Part</th><th>Qty</th></tr></thead><tbody><tr><td>' || l_partkey || '</td><td>' || l_linenumber || '</td></tr>'
  || CASE WHEN l_partkey % 3 = 0 THEN '<tr><td>a</td><td>b</td><td>c</td><td>d</td></tr>' ELSE '' END || '</tbody></table>' END AS html FROM lineitem""")
def _(spark, sf):
    wide = F.expr(_WIDE)
    return V.table(spark, sf, "lineitem").select(*V.TEXT_KEY, T.pipes_to_html(wide).alias("html"))


@add("table_clean", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'a,b|' || l_partkey || ',' ELSE 'a,b|,x|c,' END AS rows FROM lineitem""")
def _(spark, sf):
    row = lambda *cells: F.array(*[F.lit(c) if not hasattr(c, "cast") else c.cast("string") for c in cells])
    none = F.lit(None).cast("string")
    raw = F.when(C("l_linenumber") % 3 == 0, F.array(row("a", " b "), row(" ", none))).when(C("l_linenumber") % 3 == 1, F.array(row("a", " b "), row(none, ""), row(C("l_partkey"), none))).otherwise(F.array(row("a", "b"), row("", " x"), row("c ", none)))
    shown = F.array_join(F.transform(T.clean_table(raw), lambda r: F.array_join(r, ",")), "|")
    return V.table(spark, sf, "lineitem").select(*V.TEXT_KEY, shown.alias("rows"))


_TROWS = "r0 AS (SELECT l_orderkey AS table_id, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS row FROM lineitem)"


@add("table_markdown", f"""WITH {_TROWS}, l AS (SELECT table_id, row, '| ' || l_partkey || ' | ' || l_suppkey || ' | ' || CAST(l_quantity AS BIGINT) || ' | a long remark for width ' || (l_partkey % 7) || repeat('.', 60) || ' |' || chr(10) AS line FROM r0),
  h AS (SELECT '| Part | Supplier | Mass (kg) | Remark |' || chr(10) || '|---|---|---|---|' || chr(10) AS head), z AS (SELECT table_id, arg_min(length(line), row) AS len, count(*) AS n FROM l GROUP BY 1),
  p AS (SELECT z.*, head, CASE WHEN length(head) + n * len <= 600 THEN n ELSE greatest(1, (600 - length(head) - 100) // len) END AS per FROM z, h)
  SELECT table_id, CAST((row - 1) // per + 1 AS INTEGER) AS section, CAST(ceil(any_value(n) / any_value(per)::DOUBLE) AS INTEGER) AS sections, count(*) AS rows, any_value(head) || string_agg(line, '' ORDER BY row) AS content
  FROM l JOIN p USING (table_id) GROUP BY table_id, (row - 1) // per + 1""")
def _(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    s = lambda c: C(c).cast("string")
    remark = F.concat(F.lit("a long remark for width "), (C("l_partkey") % 7).cast("string"), F.repeat(F.lit("."), F.lit(60)))
    rows = V.table(spark, sf, "lineitem").select(
        C("l_orderkey").alias("table_id"), F.row_number().over(w).alias("row"), F.array(F.lit("Part"), F.lit("Supplier"), F.lit("Mass (kg)"), F.lit("Remark")).alias("headers"),
        F.array(s("l_partkey"), s("l_suppkey"), C("l_quantity").cast("long").cast("string"), remark).alias("cells"),
    )
    return T.markdown_sections(rows)


# --- chunks --------------------------------------------------------------------------------------------------------
@add("doc_chunks_fixed", f"WITH {V.CHUNKS} SELECT doc_id, chunk_index, chunk_id, length(content) AS n_chars FROM v_chunks")
def _(spark, sf):
    return V.chunks(spark, sf).select("doc_id", "chunk_index", "chunk_id", F.length("content").cast("long").alias("n_chars"))


@add("doc_full_text", f"WITH {V.CHUNKS} SELECT doc_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS full_md5, count(*) AS chunks, count(DISTINCT page) AS pages FROM v_chunks GROUP BY doc_id")
def _(spark, sf):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda s: s["content"]), "\n\n")
    return V.chunks(spark, sf).groupBy("doc_id").agg(F.md5(text.cast("binary")).alias("full_md5"), F.count("*").alias("chunks"), F.countDistinct("page").alias("pages"))


@add("doc_preview", f"WITH {V.CHUNKS} SELECT doc_id, max(content) FILTER (chunk_index = 0) AS chunk_0, max(content) FILTER (chunk_index = 1) AS chunk_1 FROM v_chunks WHERE chunk_index IN (0, 1) GROUP BY doc_id")
def _(spark, sf):
    at = lambda i: F.max(F.when(C("chunk_index") == i, C("content"))).alias(f"chunk_{i}")
    return V.chunks(spark, sf).where(C("chunk_index").isin(0, 1)).groupBy("doc_id").agg(at(0), at(1))


@add("page_join", f"WITH {V.CHUNKS}, p AS (SELECT doc_id, page, sum(len(regexp_extract_all(content, '[0-9]+'))) AS numbers FROM v_chunks WHERE page % 2 = 1 GROUP BY ALL) SELECT c.doc_id, c.chunk_index, c.page, p.numbers FROM v_chunks c LEFT JOIN p ON p.doc_id = c.doc_id AND p.page = c.page")
def _(spark, sf):
    c = V.chunks(spark, sf)
    n = F.sum(F.size(F.regexp_extract_all("content", F.lit("([0-9]+)"), F.lit(1)))).alias("numbers")
    return c.select("doc_id", "chunk_index", "page").join(c.where("page % 2 = 1").groupBy("doc_id", "page").agg(n), ["doc_id", "page"], "left")


@add("page_order", f"WITH {V.CHUNKS} SELECT doc_id, chunk_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY page DESC, chunk_index) AS place FROM v_chunks")
def _(spark, sf):
    w = Window.partitionBy("doc_id").orderBy(F.desc("page"), "chunk_index")
    return V.chunks(spark, sf).select("doc_id", "chunk_id", "chunk_index", F.row_number().over(w).cast("long").alias("place"))


@add("doc_chunks_recursive", None)
def _(spark, sf):
    from millrace.operators.chunking import split_documents

    return split_documents(V.table(spark, sf, "documents"))


@add("word_set_ops", r"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark),
  u AS (SELECT doc_id, unnest(w) AS w FROM d), s AS (SELECT doc_id, count(*) AS shared FROM u JOIN b USING (w) GROUP BY 1) SELECT d.doc_id, coalesce(shared, 0) AS shared, len(d.w) - coalesce(shared, 0) AS own FROM d LEFT JOIN s ON s.doc_id = d.doc_id""")
def _(spark, sf):
    ws = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)))
    told = V.table(spark, sf, "benchmark").select(F.explode(ws("text")).alias("w")).distinct().withColumn("hit", F.lit(1))
    rows = V.table(spark, sf, "documents").select("doc_id", F.explode_outer(ws("text")).alias("w")).join(told, "w", "left")
    shared = F.count("hit")
    return rows.groupBy("doc_id").agg(shared.alias("shared"), (F.count("w") - shared).alias("own"))
