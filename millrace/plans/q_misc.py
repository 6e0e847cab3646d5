"""Lexicon, layout, prompt, session, time, source and sink queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import lexicon
from millrace.operators import chat as H
from millrace.operators import layout, tools
from millrace.operators import prompts as P
from millrace.operators.vectors import nearest
from millrace.plans import views as V
from millrace.plans.q_matching import _VEC, _vectors
from millrace.sources import tables as S
from millrace.streaming import sessions as T

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


# --- lexicon ---------------------------------------------------------------------------------------------------------
def _asked(spark, sf):
    names = list(lexicon.LEXICON)
    return V.table(spark, sf, "events").select("event_id", V.pick(names, C("event_id") % len(names)).alias("category"))


_ASKED = "asked AS (SELECT event_id, list_extract([" + ", ".join(f"'{k}'" for k in lexicon.LEXICON) + f"], CAST(event_id % {len(lexicon.LEXICON)} AS INTEGER) + 1) AS category FROM events)"
_SUG = f"""WITH {lexicon.SQL}, {_ASKED}, x AS (SELECT event_id, category, core, unnest(extended) AS w FROM asked JOIN lexicon USING (category)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY md5(event_id || ':' || w), w) AS r FROM x), k AS (SELECT event_id, category, any_value(core) AS core, list(w ORDER BY r) AS e FROM r GROUP BY ALL),
s AS (SELECT event_id, category, core, (core || e[1:greatest(2, 5 - len(core))])[1:8] AS words FROM k)"""


@add("keyword_suggest", _SUG + " SELECT event_id, category, array_to_string(words, ',') AS words FROM s")
def _(spark, sf):
    return _asked(spark, sf).select("event_id", "category", F.array_join(lexicon.suggest(C("category"), C("event_id").cast("string")), ",").alias("words"))


@add("keyword_frequency", _SUG + ", u AS (SELECT unnest(words) AS word FROM s) SELECT word, count(*) AS n, round(count(*) / (SELECT count(*) FROM u), 6) AS share FROM u GROUP BY word")
def _(spark, sf):
    u = _asked(spark, sf).select(F.explode(lexicon.suggest(C("category"), C("event_id").cast("string"))).alias("word"))
    counts = u.groupBy("word").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(u.agg(F.count("*").alias("all")))).select("word", "n", F.round(C("n") / C("all"), 6).alias("share"))


@add("keyword_breakdown", _SUG + " SELECT event_id, len(list_intersect(words, core)) AS core, len(words) - len(list_intersect(words, core)) AS extended FROM s")
def _(spark, sf):
    w, core = lexicon.suggest(C("category"), C("event_id").cast("string")), lexicon.core(C("category"))
    return _asked(spark, sf).select("event_id", F.size(F.array_intersect(w, core)).cast("long").alias("core"), F.size(F.array_except(w, core)).cast("long").alias("extended"))


# --- page layout -------------------------------------------------------------------------------------------------------
_BOX = "SELECT l_orderkey AS page, l_partkey, l_suppkey, l_linenumber, l_quantity * 10 AS x0, l_quantity * 10 + 30 + l_linenumber AS x1, (l_partkey % 100) * 7.0 AS top, (l_partkey % 100) * 7.0 + 10 AS bottom FROM lineitem"


def _boxes(spark, sf):
    x, y = C("l_quantity") * 10, (C("l_partkey") % 100) * 7.0
    return V.table(spark, sf, "lineitem").select(C("l_orderkey").alias("page"), "l_partkey", "l_suppkey", "l_linenumber", x.alias("x0"), (x + 30 + C("l_linenumber")).alias("x1"), y.alias("top"), (y + 10).alias("bottom"))


@add("bbox_filter", f"""WITH b AS ({_BOX}), t AS (SELECT l_orderkey AS page, min(l_quantity) * 10 AS tx0, min(l_quantity) * 10 + 200 AS tx1, 0.0 AS ttop, 350.0 AS tbottom FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1)
  SELECT page, l_partkey, l_suppkey, l_linenumber, x0 FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND greatest(0, least(x1, tx1) - greatest(x0, tx0)) * greatest(0, least(bottom, tbottom) - greatest(top, ttop)) >= 0.5 * (x1 - x0) * (bottom - top))""")
def _(spark, sf):
    low = V.table(spark, sf, "lineitem").where("l_linenumber <= 3").groupBy(C("l_orderkey").alias("page")).agg((F.min("l_quantity") * 10).alias("x0"))
    tables = low.select("page", "x0", (C("x0") + 200).alias("x1"), F.lit(0.0).alias("top"), F.lit(350.0).alias("bottom"))
    return layout.outside(_boxes(spark, sf), tables).select("page", "l_partkey", "l_suppkey", "l_linenumber", "x0")


@add("line_assembly", None)
def _(spark, sf):
    words = _boxes(spark, sf).select("page", "top", "x0", F.concat(F.lit("w"), C("l_partkey").cast("string")).alias("word"))
    return layout.lines(words)


# --- prompts -----------------------------------------------------------------------------------------------------------
_LINES = """WITH f AS (SELECT l_orderkey AS session_id, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS seq, l_partkey, l_suppkey, l_linenumber, name, category, flow_type, CAST(CAST(value AS BIGINT) AS VARCHAR) AS value, unit FROM (SELECT *, session_id AS l_orderkey FROM v_lci)),
  r AS (SELECT session_id, category || ': ' || name AS flow, arg_max(l_linenumber, seq) AS n FROM f WHERE l_partkey % 3 = 0 GROUP BY ALL),
  x AS (SELECT f.*, r.n, CASE WHEN flow_type = 'Output' AND l_suppkey % 2 = 0 THEN ', ' || l_linenumber || ' units' ELSE '' END AS many, name || ' (' || category || ')' AS named, l_partkey % 7 = 0 AS nodes FROM f LEFT JOIN r ON r.session_id = f.session_id AND r.flow = category || ': ' || name),
  l AS (SELECT session_id, CASE WHEN flow_type = 'Input' THEN 0 ELSE 1 END AS part, seq, 0 AS k, CASE WHEN n IS NOT NULL THEN '[CALCULABLE] ' || named || ': ' || value || ' ' || unit || many WHEN nodes THEN '[CALCULABLE] ' || named || ': parameters are power: ' || l_linenumber || ' W, time: 2 h, final value is ' || value || ' ' || unit || many
    ELSE '[DIRECT] ' || named || ': ' || value || ' ' || unit || many END AS line FROM x UNION ALL SELECT session_id, CASE WHEN flow_type = 'Input' THEN 0 ELSE 1 END, seq, 1, '  → Calculation: value x ' || n FROM x WHERE n IS NOT NULL
    UNION ALL SELECT session_id, CASE WHEN flow_type = 'Input' THEN 0 ELSE 1 END, seq, 2, '  → Uses parameters: power, time ' || n FROM x WHERE n IS NOT NULL UNION ALL SELECT o_orderkey, 2, 0, 0, '[CONTEXT] Total: ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' EUR' FROM orders)""".replace("WITH f", f"WITH {V.LCI}, f")


def _documents(spark, sf):
    """Flows, parameters and relations of each order's document."""
    part, supp, line = C("l_partkey"), C("l_suppkey"), C("l_linenumber")
    node = lambda n, v, u: F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(u).alias("unit"))
    rows = V.lci(spark, sf).withColumn("seq", part * 1000000 + supp * 100 + line)
    nodes = F.when(part % 7 == 0, F.array(node("power", line.cast("string"), "W"), node("time", F.lit("2"), "h")))
    flows = rows.select("session_id", "seq", C("flow_type").alias("side"), "category", "name", C("value").cast("long").cast("string").alias("value"), "unit", F.when(supp % 2 == 0, line).alias("quantity"), nodes.alias("child_nodes"))
    used = F.array(F.lit("power"), F.concat(F.lit("time "), line.cast("string")))
    relations = rows.where(part % 3 == 0).select("session_id", "seq", F.concat("category", F.lit(": "), "name").alias("flow"), F.concat(F.lit("value x "), line.cast("string")).alias("calculation"), used.alias("parameters_used"))
    orders = V.table(spark, sf, "orders").select(C("o_orderkey").alias("session_id"), "o_totalprice", "o_orderpriority")
    parameters = orders.select("session_id", F.lit(0).cast("long").alias("seq"), F.lit("Total").alias("name"), F.floor("o_totalprice").cast("string").alias("value"), F.lit("EUR").alias("unit"))
    return orders.select("session_id", F.when(C("session_id") % 4 > 0, C("o_orderpriority")).alias("process_name")), flows, parameters, relations


@add("document_prompt_lines", _LINES + " SELECT session_id, part, seq, k, line, count(*) AS n FROM l GROUP BY ALL")
def _(spark, sf):
    return P.document_lines(*_documents(spark, sf)[1:], "complex").groupBy("session_id", "part", "seq", "k", "line").agg(F.count("*").alias("n"))


_PROMPTED = """, t AS (SELECT session_id, string_agg('- ' || line, chr(10) ORDER BY part, seq, k, line) AS lines FROM l{0} GROUP BY session_id)
  SELECT o_orderkey AS session_id, md5('Process: ' || CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority ELSE 'AM Process' END || chr(10) || chr(10) || 'Data to document:' || chr(10) || coalesce(lines, '') || chr(10) || chr(10) || 'Note: ' || chr(10) || '{1}' ||
  CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.session_id = o_orderkey) THEN '{2}' ELSE '' END || '{3}') AS digest FROM orders LEFT JOIN t ON session_id = o_orderkey"""


def _prompted(where, difficulty, kind):
    quoted = lambda s: s.replace("'", "''")
    return _LINES + _PROMPTED.format(where, quoted("\n".join(P.LEGEND)), quoted(P.TIPS.get(difficulty, "")), quoted(P.GUIDANCE + f"\n\nWrite a formal {kind.replace('_', ' ')} " + P.CLOSING))


for _level, _kind in (("simple", "batch_production_record"), ("medium", "energy_audit"), ("complex", "technical_report")):

    @add(f"document_prompts_{_level}", _prompted("" if _level == "complex" else " WHERE k = 0", _level, _kind))
    def _(spark, sf, level=_level, kind=_kind):
        return P.document_prompts(*_documents(spark, sf), level, kind).select("session_id", F.md5(C("prompt").cast("binary")).alias("digest"))


@add("doc_variants", "SELECT p_partkey, difficulty, doc_type, md5(p_name || difficulty || doc_type) AS doc_id FROM part, (VALUES ('easy'), ('medium'), ('hard')) d(difficulty), (VALUES ('report'), ('paper'), ('table')) t(doc_type)")
def _(spark, sf):
    each = lambda *v: F.explode(F.array(*[F.lit(x) for x in v]))
    rows = V.table(spark, sf, "part").select("p_partkey", "p_name", each("easy", "medium", "hard").alias("difficulty")).withColumn("doc_type", each("report", "paper", "table"))
    return rows.select("p_partkey", "difficulty", "doc_type", F.md5(F.concat("p_name", "difficulty", "doc_type").cast("binary")).alias("doc_id"))


@add("flow_text", f"WITH {V.CATALOG} SELECT uuid, name || ' ' || array_to_string(categories, ' ') || ' ' || substring(category, 1, 200) AS text FROM v_catalog")
def _(spark, sf):
    return V.catalog(spark, sf).select("uuid", P.flow_text(C("name"), C("categories"), C("category")).alias("text"))


@add("vector_text", f"WITH {V.CATALOG} SELECT uuid, concat_ws(' | ', 'Name: ' || name, 'Category: ' || nullif(category, ''), CASE WHEN p_size % 2 = 0 THEN 'Location: ' || location END, 'Unit: ' || unit) AS text FROM v_catalog")
def _(spark, sf):
    rows = V.catalog(spark, sf).join(V.table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    return rows.select("uuid", P.labelled(Name=C("name"), Category=C("category"), Location=F.when(C("p_size") % 2 == 0, C("location")), Unit=C("unit")).alias("text"))


@add("prompt_preview", "SELECT doc_id, 'Document: ' || source || chr(10) || CASE WHEN length(text) <= 500 THEN text ELSE substring(text, 1, 500) || '...' END AS prompt FROM documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", P.preview(C("source"), C("text")).alias("prompt"))


@add("history_text", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) SELECT conv_id, string_agg(upper(role) || ': ' || substring(text, 1, 200), chr(10) ORDER BY turn) AS history FROM x WHERE b <= 3 GROUP BY conv_id")
def _(spark, sf):
    return H.history_text(V.table(spark, sf, "conversations"))


_HINT = """CASE WHEN contains(x, '316l') THEN '316L stainless steel' WHEN contains(x, 'stainless steel') OR contains(x, 'x2crni') THEN 'stainless steel' WHEN contains(x, 'steel') AND contains(x, 'powder') THEN 'steel powder'
  WHEN contains(x, 'titanium') OR contains(x, 'ti6al4v') OR contains(x, 'ti-6al-4v') THEN 'titanium alloy' WHEN contains(x, 'aluminum') OR contains(x, 'aluminium') THEN 'aluminum' END"""


@add("material_hints", f"""WITH {V.TEXTS}, t AS (SELECT l_orderkey AS session_id, lower(['aluminium', 'Ti-6Al-4V', 'wire', 'X2CrNi']
  [CAST(l_suppkey % 4 AS INTEGER) + 1] || ' ' || text) AS x FROM v_text WHERE l_linenumber % 3 < 2) SELECT session_id, coalesce(string_agg(DISTINCT {_HINT}, ',' ORDER BY {_HINT}), '') AS hints FROM t GROUP BY session_id""")
def _(spark, sf):
    category = F.when(C("l_linenumber") % 3 == 0, "Raw Material").when(C("l_linenumber") % 3 == 1, "Process Material").otherwise("Gas")
    flows = V.texts(spark, sf).select(C("l_orderkey").alias("session_id"), category.alias("category"), V.pick(("aluminium", "Ti-6Al-4V", "wire", "X2CrNi"), C("l_suppkey") % 4).alias("name"), C("text").alias("note"))
    return P.material_hints(flows).select("session_id", F.array_join("hints", ",").alias("hints"))


_REPLY = """CASE p_partkey % 5 WHEN 0 THEN '<think>about ' || p_type || '</think> "' || p_name || '" ' WHEN 1 THEN '<think>a</think>x<think>b</think> ' || {q} || p_name || {q} WHEN 2 THEN '' WHEN 3 THEN p_name || '</think> ' || p_type ELSE repeat('long ', 30) END"""


@add("rewrite_cleanup", f"""WITH x AS (SELECT p_partkey, p_type, {_REPLY.format(q='chr(39)')} AS r FROM part), t AS (SELECT *, trim(trim(trim(CASE WHEN contains(r, '<think>') AND contains(r, '</think>') THEN string_split(r, '</think>')[-1] ELSE r END), '"' || chr(39))) AS b FROM x)
  SELECT p_partkey, CASE WHEN length(b) > 0 AND length(b) < 100 THEN b ELSE p_type END AS name FROM t""")
def _(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", P.rewritten(F.expr(_REPLY.format(q="char(39)")), C("p_type")).alias("name"))


@add("context_summary", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'No PDF context information available' ELSE 'Section 1: ' || p_name || '...' || chr(10) || 'Section 2: ' || p_type || '...' || chr(10) || 'Section 3: ...' END AS context,
  CASE WHEN p_size % 5 = 0 THEN 'No available LCI flow data' ELSE '- ' || p_name || ', UUID: ' || p_partkey || ', Unit: , Location: GLO' END AS flows FROM part""")
def _(spark, sf):
    some = C("p_size") % 5 != 0
    contents = F.when(some, F.array("p_name", "p_type", F.lit(None).cast("string"), "p_brand")).otherwise(F.array().cast("array<string>"))
    flow = F.struct(C("p_name").alias("name"), C("p_partkey").cast("string").alias("uuid"), F.lit(None).cast("string").alias("unit"), F.lit("GLO").alias("location"))
    flows = F.when(some, F.array(flow)).otherwise(F.slice(F.array(flow), 1, 0))
    return V.table(spark, sf, "part").select("p_partkey", P.context_summary(contents).alias("context"), P.lci_summary(flows).alias("flows"))


# --- sessions and time -------------------------------------------------------------------------------------------------
@add("session_expiry", "WITH l AS (SELECT user_id, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY 1), e AS (SELECT max(ts) AS now FROM events) SELECT user_id, n, last_ts, CAST(floor(epoch(now)) - floor(epoch(last_ts)) AS BIGINT) AS idle_seconds, floor(epoch(now)) - floor(epoch(last_ts)) > 7200 AS expired FROM l, e")
def _(spark, sf):
    return T.idle(V.table(spark, sf, "events"))


@add("chat_expiry", "WITH l AS (SELECT user_id, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY 1), e AS (SELECT max(ts) AS now FROM events) SELECT user_id, n, last_ts, CAST(floor(epoch(now)) - floor(epoch(last_ts)) AS BIGINT) AS idle_seconds, floor(epoch(now)) - floor(epoch(last_ts)) >= 3600 AS expired FROM l, e")
def _(spark, sf):
    return T.idle(V.table(spark, sf, "events"), T.CHAT_TIMEOUT, inclusive=True)


@add("session_touch", """WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
  SELECT user_id, event_id, CAST(floor(epoch(ts)) - floor(epoch(b)) AS BIGINT) AS idle_seconds, coalesce(floor(epoch(ts)) - floor(epoch(b)) <= 7200, false) AS alive FROM l""")
def _(spark, sf):
    return T.touched(V.table(spark, sf, "events"))


@add("session_stats", "SELECT source, count(*) AS documents, sum(strlen(text)) / 1048576.0 AS mb, count(*) FILTER (n_chars > 1000) AS long_ones FROM documents GROUP BY source")
def _(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.groupBy("source").agg(F.count("*").alias("documents"), (F.sum(F.octet_length("text")) / 1048576).alias("mb"), F.count_if(C("n_chars") > 1000).alias("long_ones"))


@add("session_windows", """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS b FROM events),
  s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def _(spark, sf):
    return T.sessionized(V.table(spark, sf, "events")).drop("total")


@add("daily_event_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    return T.windowed(V.table(spark, sf, "events"))


@add("sessionized_stream", None)
def _(spark, sf):
    """The stream over the events file, run to its end, as a table."""
    batch = V.table(spark, sf, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = S.scratch(spark, "sequenced")
    query = T.sequenced(stream).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.parquet(out)


@add("action_numbering", "SELECT user_id, event_id, printf('ACT_%04d', row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS action_id FROM events")
def _(spark, sf):
    return T.numbered(V.table(spark, sf, "events"))


@add("timestamps_and_json", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, date_diff('minute', date_trunc('hour', ts), date_trunc('minute', ts)) AS minutes FROM events")
def _(spark, sf):
    k = F.from_json("props", "k int")["k"]
    minutes = F.timestamp_diff("MINUTE", F.date_trunc("hour", "ts"), F.date_trunc("minute", "ts"))
    return V.table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"), k.alias("k"), minutes.alias("minutes"))


# --- sources and sinks ---------------------------------------------------------------------------------------------------
@add("base64_roundtrip", "SELECT doc_id, text FROM documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", S.decoded(F.base64(C("text").cast("binary"))).alias("text"))


@add("json_source_roundtrip", "SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def _(spark, sf):
    path = S.scratch(spark, "orders")
    S.write_json_lists(V.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity"), path)
    rows = S.read_json_list(spark, path, "l_orderkey long, l_quantity double")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))


@add("jsonl_sinks", "SELECT CASE WHEN conv_id % 10 = 0 THEN 'eval' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")
def _(spark, sf):
    path = S.scratch(spark, "samples")
    S.write_samples(V.table(spark, sf, "conversations").withColumn("part", F.when(C("conv_id") % 10 == 0, "eval").otherwise("train")), path)
    rows = spark.read.schema("conv_id long, turn long, role string, text string, part string").json(path)
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"))


@add("partitioned_sink", "SELECT lang AS difficulty, source AS doc_type, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, sf):
    path = S.scratch(spark, "documents")
    S.write_documents(V.table(spark, sf, "documents").select("doc_id", C("lang").alias("difficulty"), C("source").alias("doc_type")), path)
    return spark.read.json(path).groupBy("difficulty", "doc_type").agg(F.count("*").alias("n"))


@add("vector_index_lifecycle", _VEC.format(eps="1e-8") + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def _(spark, sf):
    """A temporary collection is built, asked and dropped; the answers are written before it goes."""
    path = S.scratch(spark, "collection")
    queries, vectors = _vectors(spark, sf)
    S.build_collection(vectors.select("vec_id", "v"), path)
    hits = S.checkpointed(nearest(queries, spark.read.parquet(path), 3, eps=1e-8).select("query_id", "vec_id", "rank"))
    S.delete(spark, path)
    return hits


@add("tagged_sources", "SELECT event_type AS kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1")
def _(spark, sf):
    """One write deals all kinds into folders, whatever they are called."""
    path = S.scratch(spark, "tagged")
    V.table(spark, sf, "events").select("event_id", C("event_type").alias("kind")).write.partitionBy("kind").json(path)
    return S.read_tagged(spark, path, "event_id long").groupBy("kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@add("session_rewrite", "SELECT user_id % 4 AS session_id, CASE WHEN user_id % 4 = 2 THEN 'new' ELSE 'old' END AS version, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 9, 'appended', count(*) FROM events WHERE event_id % 2 = 0")
def _(spark, sf):
    path = S.scratch(spark, "sessions")
    rows = V.table(spark, sf, "events").select("event_id", F.lit("old").alias("version"), (C("user_id") % 4).alias("session_id"))
    rows.write.partitionBy("session_id").parquet(path)
    S.rewrite_sessions(spark, path, rows.where("session_id = 2").withColumn("version", F.lit("new")))
    S.append(rows.where("event_id % 2 = 0").withColumns({"version": F.lit("appended"), "session_id": F.lit(9).cast("long")}), path, "session_id")
    return spark.read.schema("event_id long, version string, session_id long").parquet(path).groupBy("session_id", "version").agg(F.count("*").alias("n"))


_ARGUMENTS = """t(place, tool, arguments) AS (VALUES (0, 'process_document', ['file_content', 'filename']), (1, 'search_document', []), (2, 'record_document_preview', []), (3, 'build_lca_system', ['system_description', 'functional_unit']), (4, 'search_lci_database', ['query']),
  (5, 'define_lca_scope', ['parameter_name', 'description']), (6, 'record_process_flow', ['flow_type', 'category', 'name', 'value', 'unit']), (7, 'record_parameter', ['parameter_name', 'parameter_value', 'selected_chunk']),
  (8, 'record_calculation', ['calculation_expression', 'calculation_result', 'data_dependencies', 'expert_decision']), (9, 'execute_calculation', ['expression']), (10, 'get_session_summary', []))"""


@add("tool_schema", f"""WITH {_ARGUMENTS}, c AS (SELECT event_id, event_id % 12 AS place, CASE event_id % 5 WHEN 0 THEN ['session_id', 'name', 'value', 'unit'] WHEN 1 THEN ['query', 'expression', 'filename', 'file_content'] WHEN 2 THEN ['parameter_name', 'description', 'extra'] ELSE [] END AS given FROM events)
  SELECT coalesce(tool, 'unknown') AS tool, array_to_string(list_filter(coalesce(arguments, []), lambda a: NOT list_contains(given, a)), ',') AS missing, count(*) AS n FROM c LEFT JOIN t USING (place) GROUP BY ALL""")
def _(spark, sf):
    """Calls, one for each event, and the arguments that their tools require and they lack."""
    n = C("event_id")
    given = F.when(n % 5 == 0, F.array(*map(F.lit, ("session_id", "name", "value", "unit")))).when(n % 5 == 1, F.array(*map(F.lit, ("query", "expression", "filename", "file_content"))))
    given = given.when(n % 5 == 2, F.array(*map(F.lit, ("parameter_name", "description", "extra")))).otherwise(F.array().cast("array<string>"))
    calls = V.table(spark, sf, "events").select(V.pick((*tools.TOOLS, "unknown"), n % 12).alias("tool"), given.alias("given"))
    return tools.missing(calls).groupBy("tool", F.array_join("missing", ",").alias("missing")).agg(F.count("*").alias("n"))


@add("flow_type_display", f"WITH {V.LCI} SELECT category, CASE WHEN category = 'Emission' THEN 'Output' ELSE flow_type END AS stored, count(*) AS n FROM v_lci GROUP BY ALL")
def _(spark, sf):
    shown = F.when(C("category") == "Emission", "Emission").otherwise(C("flow_type"))
    return V.lci(spark, sf).withColumn("shown", shown).groupBy("category", F.when(C("shown") == "Emission", "Output").otherwise(C("shown")).alias("stored")).agg(F.count("*").alias("n"))
