"""Life-cycle-inventory views over the driver's tables, in Spark and, for the oracle, in SQL.

``ACTIONS``, ``LCI``, ``CATALOG``, ``CHUNKS``, ``TEXTS`` are common table expressions that say the same in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.action_log import derived_link

INPUTS = ("Raw Material", "Process Energy", "Post-processing Energy", "Feedstock Energy", "Gas", "Cooling Media")
OUTPUTS = ("Product", "Recovered Material", "Waste", "Emission")
CATEGORIES = INPUTS + OUTPUTS
SCOPES = ("Function Unit", "System Boundary", "Geographical Scope", "Functional Unit")
UNITS = ("kg", "g", "kWh", "MJ", "m3", "L", "item(s)")
CATALOG_UNITS = ("kg", "MJ", "m3", "item(s)", "kBq")
KINDS = ("Metals", "Energy carriers and technologies", "Emission to air", "Waste treatment", "Emission to water")
FLOW_TYPES = ("PRODUCT_FLOW", "ELEMENTARY_FLOW", "WASTE_FLOW")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(values, index):
    """The value at a 0-based index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """The append-only action log: one session for each user, one action for each event."""
    e, skip = table(spark, sf, "events"), F.col("event_id") % 17 == 0
    kind = F.when(skip, "smart_skip")
    for event, record in (("signup", "scope"), ("view", "parameter"), ("purchase", "flow"), ("click", "calculation")):
        kind = kind.when(F.col("event_type") == event, record)
    e = e.withColumn("record_type", kind.otherwise("pivot"))
    again = F.col("record_type").isin("flow", "parameter") & (F.col("event_id") % 7 == 0)
    intent = (
        F.when(skip, "smart_skip").when(F.col("record_type") == "calculation", "calculate")
        .when(F.col("record_type") == "pivot", "pivot_query").when(again, "refine_same").otherwise("select_best")
    )
    session = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("intent", intent).withColumn("seq", F.row_number().over(session)).withColumn("action_id", F.format_string("ACT_%04d", "seq"))
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.concat(F.lit("S"), F.col("user_id")).alias("session_id"), "seq", "action_id", "record_type", "intent",
        derived_link(session).alias("link_to"), F.col("ts").alias("created_at"), F.col("value"), k.alias("k"),
        pick(CATEGORIES, k % 10).alias("category"), F.when(F.col("record_type") == "scope", pick(SCOPES, k % 4)).otherwise(F.concat(F.lit("item "), k % 7)).alias("name"),
        F.concat(F.lit("query "), F.floor(F.col("event_id") / 3) % 4).alias("search_query"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("chunk_"), k)).alias("chunk_id"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("process "), k % 3)).alias("process_name"),
    )


_CATEGORY = "list_extract(['" + "','".join(CATEGORIES) + "'], CAST({0} AS INTEGER) + 1)"
ACTIONS = f"""
v0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN event_id % 17 = 0 THEN 'smart_skip'
  WHEN event_type = 'signup' THEN 'scope' WHEN event_type = 'view' THEN 'parameter' WHEN event_type = 'purchase' THEN 'flow'
  WHEN event_type = 'click' THEN 'calculation' ELSE 'pivot' END AS record_type FROM events),
v1 AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN 'smart_skip' WHEN record_type = 'calculation' THEN 'calculate'
  WHEN record_type = 'pivot' THEN 'pivot_query' WHEN record_type IN ('flow', 'parameter') AND event_id % 7 = 0 THEN 'refine_same'
  ELSE 'select_best' END AS intent, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq FROM v0),
v2 AS (SELECT *, printf('ACT_%04d', seq) AS action_id, lag(intent) OVER (PARTITION BY user_id ORDER BY seq) AS before FROM v1),
v_actions AS (SELECT 'S' || user_id AS session_id, seq, action_id, record_type, intent,
  CASE WHEN record_type IN ('pivot', 'smart_skip', 'calculation') OR intent = 'refine_same' OR (intent = 'select_best' AND before = 'pivot_query')
    OR (record_type = 'flow' AND before = 'calculate') THEN lag(action_id) OVER (PARTITION BY user_id ORDER BY seq) END AS link_to,
  ts AS created_at, value, k, {_CATEGORY.format('k % 10')} AS category, CASE WHEN record_type = 'scope' THEN list_extract(['Function Unit', 'System Boundary', 'Geographical Scope', 'Functional Unit'], CAST(k % 4 AS INTEGER) + 1) ELSE 'item ' || (k % 7) END AS name,
  'query ' || (event_id // 3 % 4) AS search_query, CASE WHEN event_id % 3 <> 0 THEN 'chunk_' || k END AS chunk_id,
  CASE WHEN event_id % 5 <> 0 THEN 'process ' || (k % 3) END AS process_name FROM v2)"""


def lci(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded exchanges: one session for each order."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    category = pick(CATEGORIES, F.col("l_partkey") % 10)
    return rows.select(
        F.col("l_orderkey").alias("session_id"), "l_partkey", "l_suppkey", "l_linenumber", F.col("p_name").alias("name"), category.alias("category"),
        F.when(F.col("l_partkey") % 10 < 6, "Input").otherwise("Output").alias("flow_type"), F.col("l_quantity").alias("value"),
        pick(UNITS, F.col("l_linenumber") % 7).alias("unit"), "l_discount",
    )


LCI = f"""
v_lci AS (SELECT l_orderkey AS session_id, l_partkey, l_suppkey, l_linenumber, p_name AS name, {_CATEGORY.format('l_partkey % 10')} AS category,
  CASE WHEN l_partkey % 10 < 6 THEN 'Input' ELSE 'Output' END AS flow_type, l_quantity AS value,
  list_extract(['{"','".join(UNITS)}'], CAST(l_linenumber % 7 AS INTEGER) + 1) AS unit, l_discount
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Reference flows."""
    p = table(spark, sf, "part")
    unit = pick(CATALOG_UNITS, F.col("p_size") % 5)
    properties = F.array(
        F.struct(F.lit(False).alias("isRefFlowProperty"), F.lit("EUR").alias("refUnit")), F.struct((F.col("p_size") % 11 != 0).alias("isRefFlowProperty"), unit.alias("refUnit"))
    )
    return p.select(
        F.col("p_partkey").cast("string").alias("uuid"), F.col("p_name").alias("name"), F.array("p_type", "p_brand", pick(KINDS, F.col("p_partkey") % 5)).alias("categories"),
        pick(FLOW_TYPES, F.col("p_size") % 3).alias("flow_type"), unit.alias("unit"), F.col("p_brand").alias("reference_product"),
        F.col("p_type").alias("category"), F.concat(F.lit("GLO"), F.col("p_size") % 4).alias("location"), properties.alias("flow_properties"), "p_partkey",
    )


CATALOG = f"""
v_catalog AS (SELECT CAST(p_partkey AS VARCHAR) AS uuid, p_name AS name, [p_type, p_brand, list_extract(['{"','".join(KINDS)}'], CAST(p_partkey % 5 AS INTEGER) + 1)] AS categories,
  list_extract(['{"','".join(FLOW_TYPES)}'], CAST(p_size % 3 AS INTEGER) + 1) AS flow_type,
  list_extract(['{"','".join(CATALOG_UNITS)}'], CAST(p_size % 5 AS INTEGER) + 1) AS unit, p_brand AS reference_product,
  p_type AS category, 'GLO' || (p_size % 4) AS location, p_size, p_partkey FROM part)"""

SIZE, STEP = 600, 450


def chunks(spark: SparkSession, sf: str, size: int = SIZE, step: int = STEP) -> DataFrame:
    """Windows of ``size`` characters, each ``step`` after the last, until one reaches the end; ``size`` is at most twice ``step``.

    A text is cut once into pieces of ``step`` characters; a window is a piece and the beginning of the next, so the work
    grows with the text's length, and rows carry their windows alone.
    """
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / step)).cast("int")
    pieces = F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1))
    rows = d.select("doc_id", "source", pieces.alias("pieces"), last.alias("last"))
    piece = lambda i: F.coalesce(F.get("pieces", i), F.lit(""))
    windows = F.transform(F.sequence(F.lit(0), "last"), lambda i: F.concat(piece(i), F.substring(piece(i + 1), 1, size - step)))
    d = rows.select("doc_id", "source", F.posexplode(windows).alias("chunk_index", "content"))
    content = F.col("content")
    return d.select(
        "doc_id", "source", "chunk_index", content,
        F.concat(F.format_string("file_%03d_", "chunk_index"), F.substring(F.md5(content.cast("binary")), 1, 8)).alias("chunk_id"),
        (F.floor(F.col("chunk_index") / 3) + 1).cast("int").alias("page"),
    )


CHUNKS = f"""
c0 AS (SELECT doc_id, source, text, unnest(generate_series(0, CAST(greatest(0, ceil((length(text) - {SIZE}) / {float(STEP)})) AS INTEGER))) AS i FROM documents),
c1 AS (SELECT doc_id, source, CAST(i AS INTEGER) AS chunk_index, substring(text, CAST(i AS INTEGER) * {STEP} + 1, {SIZE}) AS content FROM c0),
v_chunks AS (SELECT *, printf('file_%03d_', chunk_index) || md5(content)[1:8] AS chunk_id, CAST(chunk_index // 3 + 1 AS INTEGER) AS page FROM c1)"""

#: Sentences and tables with quantities: what recorded documents look like.
_TEXT_PARTS = (
    "'The ' || p_name || ' consumed ' || {q} || ' kWh per tonne and ' || {q2} || ' kg of argon gas. '",
    "'Table ' || {n} || chr(10) || '| Material | Mass (kg) |' || chr(10) || '|---|---|' || chr(10) || '| 316L steel | ' || {q} || ' |' || chr(10) || '| nylon | ' || {q2} || ' |'",
    "'Electricity: ' || {q} || ' MJ; stainless  steel powder 2,500 kg; emission 12.5 kg/h. See page ' || {n} || '.'",
    "'We manufactured ' || {n} || ' parts by SLM additive manufacturing in 2015, then heat treatment and machining.'",
)


def _text_case(engine: str) -> str:
    q, q2, n = "CAST(CAST(l_quantity AS INT) AS STRING)", "CAST(CAST(l_quantity * 3 AS INT) AS STRING)", "CAST(l_linenumber AS STRING)"
    parts = [p.format(q=q, q2=q2, n=n) for p in _TEXT_PARTS]
    return "CASE l_partkey % 4 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(parts)) + " END"


def texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.expr(_text_case("spark")).alias("text"))


TEXTS = f"""
v_text AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_text_case("duckdb")} AS text
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
TEXT_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
