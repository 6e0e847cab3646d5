"""Action-log queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import action_log as L
from millrace.plans import views as V

W = f"WITH {V.ACTIONS} "
QUERIES: dict = {}
ORACLE: dict = {}


def _add(name, run, sql):
    QUERIES[name] = lambda spark, sf: run(V.actions(spark, sf))
    ORACLE[name] = W + sql


_add("session_list", L.sessions, "SELECT session_id, CAST(count(*) FILTER (record_type = 'flow') AS BIGINT) AS flows, arg_min(name, seq) FILTER (record_type = 'scope') AS scope FROM v_actions GROUP BY session_id")
_n = ", ".join(f"count(*) FILTER (record_type = '{r}') AS n_{r}" for r in L.RECORDS)
_l = ", ".join(f"count(*) FILTER (record_type = '{r}' AND link_to IS NOT NULL) AS linked_{r}" for r in ("parameter", "calculation"))
_add("session_record_type_counts", L.record_counts, f"SELECT session_id, count(*) AS n_actions, {_n}, count(link_to) AS linked_all, {_l} FROM v_actions GROUP BY session_id")
_add("session_intent_counts", L.intent_counts, "SELECT session_id, intent, count(*) AS n FROM v_actions GROUP BY ALL")
_q = "CASE WHEN record_type = 'flow' AND process_name IS NOT NULL THEN CASE WHEN chunk_id IS NOT NULL THEN 1.0 ELSE 0.5 END END"
_add("session_quality_score", L.quality, f"""SELECT session_id, round(CAST(avg({_q}) AS DOUBLE), 3) AS quality, bool_or(record_type = 'scope' AND name IN ('Function Unit', 'Functional Unit')) AS has_unit,
  bool_or(record_type = 'flow' AND category = 'Product') AS has_product, bool_or(record_type = 'flow' AND process_name IS NOT NULL) AS has_process,
  bool_or(record_type = 'parameter') AS has_parameter FROM v_actions GROUP BY session_id""")
_add("scope_last_write", L.scope_last_write, "SELECT session_id, name, arg_max(value, seq) AS value, arg_max(action_id, seq) AS action_id, count(*) AS writes FROM v_actions WHERE record_type = 'scope' GROUP BY session_id, name")
_add("skip_analysis", L.skip_analysis, """SELECT session_id, count(*) AS skips, string_agg(category, ',' ORDER BY seq) AS categories,
  string_agg(coalesce(chunk_id, '-'), ',' ORDER BY seq) AS chunks, count(DISTINCT category) AS distinct_categories FROM v_actions WHERE record_type = 'smart_skip' GROUP BY session_id""")
_add("parameter_calculation_lists", L.parameter_lists, """SELECT session_id,
  coalesce(string_agg(action_id || ':' || name || '=' || coalesce(k, 0), ';' ORDER BY seq) FILTER (record_type = 'parameter'), '') AS parameters,
  coalesce(string_agg(action_id || ':' || name || '=' || coalesce(k, 0) || '<-' || coalesce(link_to, ''), ';' ORDER BY seq) FILTER (record_type = 'calculation'), '') AS calculations
  FROM v_actions WHERE record_type IN ('parameter', 'calculation') GROUP BY session_id""")
_line = "string_agg('[' || action_id || '] ' || record_type || ' ' || name || ' (' || category || ')', chr(10) ORDER BY seq) AS summary, count(*) AS lines"
_add("summary_text_llm", lambda a: L.summary_text(a, "llm"), f"SELECT session_id, {_line} FROM v_actions WHERE record_type IN ('scope', 'flow', 'parameter') GROUP BY session_id")
_add("summary_text_workbench", lambda a: L.summary_text(a, "workbench", "ACT_0040"), f"SELECT session_id, {_line} FROM v_actions WHERE seq < 40 GROUP BY session_id")
_add("summary_snapshot", L.summary_snapshot, """SELECT session_id, count(*) FILTER (record_type IN ('scope', 'flow', 'calculation')) AS total_actions,
  coalesce(string_agg(category || ': ' || name, '|' ORDER BY seq) FILTER (record_type = 'flow'), '') AS flows,
  count(DISTINCT category) FILTER (record_type = 'flow') AS flow_categories FROM v_actions GROUP BY session_id""")
_add("action_ids", L.next_ids, """, g AS (SELECT session_id, max(CAST(split_part(action_id, '_', 2) AS INTEGER)) AS last_number, count(*) AS n FROM v_actions
  WHERE regexp_full_match(action_id, 'ACT_[0-9]{4,}') GROUP BY session_id) SELECT *, printf('ACT_%04d', last_number + 1) AS next_id FROM g""")
_p = """, x AS (SELECT *, lag(intent) OVER w AS li, lead(intent) OVER w AS ni, lead(link_to) OVER w AS nl FROM v_actions WINDOW w AS (PARTITION BY session_id ORDER BY seq))
  SELECT session_id, count(*) FILTER (intent = 'pivot_query') AS pivots, count(*) FILTER (intent = 'pivot_query' AND li = 'pivot_query') AS consecutive,
  count(*) FILTER (intent = 'pivot_query' AND ni = 'select_best' AND nl = action_id) AS successes FROM x GROUP BY session_id"""
_add("pivot_success", L.pivots, _p)
_add("recent_actions", L.recent, """, x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS b FROM v_actions)
  SELECT session_id, action_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS INTEGER) AS place, intent, record_type FROM x WHERE b <= 10""")
_add("pivot_guard", L.guards, """, x AS (SELECT session_id, seq, count(*) FILTER (intent = 'pivot_query') OVER (PARTITION BY session_id ORDER BY seq ROWS 9 PRECEDING) AS recent_pivots,
  count(*) FILTER (record_type IN ('flow', 'parameter')) OVER (PARTITION BY session_id ORDER BY seq ROWS 19 PRECEDING) AS recent_records FROM v_actions)
  SELECT *, recent_pivots >= 3 OR recent_records >= 10 AS blocked FROM x""")
QUERIES["action_chain"] = lambda spark, sf: L.chains(V.actions(spark, sf))
ORACLE["action_chain"] = W.replace("WITH", "WITH RECURSIVE", 1) + """, r AS (SELECT session_id, action_id, action_id AS root, CAST(0 AS BIGINT) AS depth FROM v_actions WHERE link_to IS NULL
  UNION ALL SELECT a.session_id, a.action_id, r.root, r.depth + 1 FROM r JOIN v_actions a ON a.session_id = r.session_id AND a.link_to = r.action_id) SELECT * FROM r"""


def _bad_rows(spark, sf):
    rows, p = V.lci(spark, sf), F.col("l_partkey")
    return rows.withColumn("flow_type", F.when(p % 13 == 0, "Both").when(p % 17 == 0, "Output").otherwise(F.col("flow_type"))).withColumn(
        "category", F.when(p % 19 == 0, "Steam").otherwise(F.col("category"))
    ).withColumns({
        "value": F.when(p % 23 != 0, F.col("value")), "chunk_id": F.when(F.col("l_suppkey") % 3 == 0, "chunk").when(F.col("l_suppkey") % 7 == 0, ""),
        "link_to": F.when(F.col("l_suppkey") % 5 == 0, "ACT_0001").when(F.col("l_suppkey") % 11 == 0, "elsewhere"),
    })


QUERIES["record_validation"] = lambda spark, sf: L.validate(_bad_rows(spark, sf), V.INPUTS, V.OUTPUTS).groupBy("error", "flow_type", "evidence").agg(F.count("*").alias("n"))
_in, _out = (", ".join(f"'{c}'" for c in x) for x in (V.INPUTS, V.OUTPUTS))
ORACLE["record_validation"] = f"""WITH {V.LCI}, b AS (SELECT CASE WHEN l_partkey % 13 = 0 THEN 'Both' WHEN l_partkey % 17 = 0 THEN 'Output' ELSE flow_type END AS flow_type,
  CASE WHEN l_partkey % 19 = 0 THEN 'Steam' ELSE category END AS category, CASE WHEN l_partkey % 23 <> 0 THEN value END AS value,
  CASE WHEN l_suppkey % 3 = 0 THEN 'document' WHEN l_suppkey % 5 = 0 THEN 'calculation' ELSE 'none' END AS evidence FROM v_lci)
  SELECT CASE WHEN flow_type NOT IN ('Input', 'Output') THEN 'flow_type must be Input or Output' WHEN category NOT IN ({_in}, {_out}) THEN 'unknown category'
  WHEN flow_type = 'Input' AND category NOT IN ({_in}) THEN 'not an input category' WHEN flow_type = 'Output' AND category NOT IN ({_out}) THEN 'not an output category'
  WHEN value IS NULL THEN 'value is missing' END AS error, flow_type, evidence, count(*) AS n FROM b GROUP BY ALL"""
QUERIES["scope_validation"] = lambda spark, sf: L.validate_scopes(_scopes(spark, sf)).groupBy("parameter_name", "error").agg(F.count("*").alias("n"))
ORACLE["scope_validation"] = """WITH s AS (SELECT CASE event_id % 6 WHEN 0 THEN 'Function Unit' WHEN 1 THEN 'System Boundary' WHEN 2 THEN 'Geographical Scope' WHEN 3 THEN 'Functional Unit' WHEN 4 THEN 'function unit' END AS parameter_name FROM events)
  SELECT parameter_name, CASE WHEN parameter_name IN ('Function Unit', 'System Boundary', 'Geographical Scope', 'Functional Unit') THEN NULL ELSE 'invalid parameter_name' END AS error, count(*) AS n FROM s GROUP BY ALL"""


def _scopes(spark, sf):
    names = ("Function Unit", "System Boundary", "Geographical Scope", "Functional Unit", "function unit", None)
    return V.table(spark, sf, "events").select(V.pick(names, F.col("event_id") % 6).alias("parameter_name"))


_add("search_query_dedup", L.repeated_queries, "SELECT session_id, seq, search_query, coalesce(search_query IS DISTINCT FROM lag(search_query) OVER (PARTITION BY session_id ORDER BY seq), false) AS emitted FROM v_actions")
_i = ", ".join(f"count(*) FILTER (intent = '{i}') AS i_{i}" for i in L.INTENTS)
_add("session_summary_wide", L.summary, f"""SELECT session_id, count(*) AS actions, {_n}, {_i}, count(link_to) AS linked, round(CAST(avg({_q}) AS DOUBLE), 3) AS quality, min(created_at) AS first_at,
  arg_max(action_id, seq) AS last_action, count(DISTINCT category) FILTER (record_type = 'flow') AS flow_categories FROM v_actions GROUP BY session_id""")


def _requests(a):
    """Requests for suggestions: one for each action, with flags from its numbers."""
    k, before = F.coalesce("k", F.lit(1)), F.lag("intent").over(L.by_seq())
    tool = F.when(F.col("record_type") == "parameter", "record_parameter").when(F.col("record_type") == "flow", "record_process_flow")
    side = F.when(k % 13 == 0, None).when(F.col("category").isin(*V.INPUTS), "Input").otherwise("Output")
    rows = a.withColumns({"tool": tool, "last_intent": before, "flow_type": side, "uncertain": k % 5 == 0, "ambiguous": k % 7 == 0, "scope_unclear": k % 11 == 0,
                          "from_calculation": k % 17 == 0, "inference_required": k % 3 == 0})
    name = F.when(k % 4 == 0, F.concat("name", F.lit(" for Reuse"))).when(k % 19 == 0, None).otherwise(F.col("name"))
    return rows.withColumns({"name": name, "value": F.floor("value").cast("long"), "unit": F.when(k % 2 == 0, "kg"), "raw_evidence": F.when(k % 9 == 0, "as told")})


_req = f""", q AS (SELECT session_id, action_id, intent, chunk_id, search_query, seq, coalesce(k, 1) AS k, CAST(floor(value) AS BIGINT) AS value, CASE WHEN record_type = 'parameter' THEN 'p' WHEN record_type = 'flow' THEN 'f' END AS tool,
  lag(intent) OVER (PARTITION BY session_id ORDER BY seq) AS last_intent, CASE WHEN coalesce(k, 1) % 13 <> 0 THEN CASE WHEN category IN ({_in}) THEN 'input' ELSE 'output' END END AS side,
  CASE WHEN coalesce(k, 1) % 4 = 0 THEN name || ' for Reuse' WHEN coalesce(k, 1) % 19 = 0 THEN NULL ELSE name END AS name, CASE WHEN coalesce(k, 1) % 2 = 0 THEN 'kg' END AS unit, CASE WHEN coalesce(k, 1) % 9 = 0 THEN 'as told' END AS raw FROM v_actions),
x AS (SELECT *, CASE WHEN intent = 'refine_same' THEN 'refine_same_chunk' WHEN intent = 'pivot_query' THEN CASE WHEN k % 7 = 0 THEN 'record_parameter_ambiguous' ELSE 'pivot_query_no_results' END
  WHEN tool = 'p' THEN CASE WHEN k % 5 = 0 THEN 'record_parameter_uncertain' WHEN k % 7 = 0 THEN 'record_parameter_ambiguous' WHEN k % 3 = 0 THEN 'record_parameter_with_inference' ELSE 'record_parameter_direct' END
  WHEN tool = 'f' THEN CASE WHEN k % 11 = 0 THEN 'record_flow_uncertain' WHEN k % 17 = 0 OR coalesce(last_intent = 'calculate', false) THEN 'record_flow_from_calculation'
    WHEN k % 3 = 0 THEN coalesce('record_flow_' || side || '_with_inference', 'record_parameter_with_inference') ELSE coalesce('record_flow_' || side, 'record_flow_uncertain') END END AS scenario FROM q)"""
_add("scenario_detect", lambda a: _requests(a).select("session_id", "action_id", L.scenario().alias("scenario")), _req + " SELECT session_id, action_id, scenario FROM x")


def _payloads(a):
    rows = _requests(a).withColumn("scenario", L.scenario())
    pairs = F.transform(F.array_sort(F.map_entries(L.scenario_payload(F.col("scenario")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("session_id", "action_id", F.array_join(pairs, ";").alias("payload"))


_plain = "'name=' || name || ';unit=' || coalesce(unit, '') || ';value=' || value"
_told = "'data=' || trim(value || ' ' || coalesce(unit, '') || ' ' || name)"
_inf = "'raw_evidence=' || coalesce(raw, 'Raw_' || name) || ';specific_material=' || name || ';unit=' || coalesce(unit, '') || ';value=' || value"
_add("scenario_payload", _payloads, _req + f""" SELECT session_id, action_id, CASE WHEN scenario = 'refine_same_chunk' THEN 'chunk_id=' || coalesce(chunk_id, 'Unknown')
  WHEN scenario IN ('pivot_query_no_results', 'record_parameter_ambiguous') THEN 'query=' || search_query
  WHEN scenario LIKE 'record_parameter%' AND (name IS NULL OR value IS NULL) THEN 'data=the extracted parameter value' WHEN scenario = 'record_parameter_direct' THEN {_plain}
  WHEN scenario = 'record_parameter_with_inference' THEN {_inf} WHEN scenario LIKE 'record_parameter%' THEN {_told} WHEN name IS NULL OR value IS NULL THEN CASE WHEN scenario IS NOT NULL THEN 'data=the extracted flow data' END
  WHEN scenario = 'record_flow_uncertain' THEN {_told} WHEN scenario LIKE '%with_inference' THEN 'note=' || CASE WHEN contains(lower(name), 'reuse') THEN 'for Reuse' ELSE '' END || ';' || {_inf}
  WHEN scenario IS NOT NULL THEN {_plain} END AS payload FROM x""")
_add("link_derivation", lambda a: a.select("session_id", "action_id", "intent", "link_to"), "SELECT session_id, action_id, intent, link_to FROM v_actions")
_add("action_scan", lambda a: a.where("record_type = 'flow' AND link_to IS NOT NULL AND session_id <> 'S1'").select("session_id", "action_id", "category", "value"),
     "SELECT session_id, action_id, category, value FROM v_actions WHERE record_type = 'flow' AND link_to IS NOT NULL AND session_id <> 'S1'")
_add("last_action", lambda a: a.groupBy("session_id").agg(F.max_by("action_id", "seq").alias("action_id"), F.max_by("intent", "seq").alias("intent"), F.max("created_at").alias("created_at")),
     "SELECT session_id, arg_max(action_id, seq) AS action_id, arg_max(intent, seq) AS intent, max(created_at) AS created_at FROM v_actions GROUP BY session_id")


def _previews(a):
    rows = a.where("record_type = 'scope'").groupBy("session_id").agg(F.min_by("name", "seq").alias("name")).select("session_id", F.lit("ACT_0001").alias("action_id"), F.concat(F.lit("preview "), "name").alias("name"))
    return L.upsert(a.select("session_id", "action_id", "name"), rows, ["session_id", "action_id"])


_add("upsert_preview", _previews, """, n AS (SELECT session_id, 'ACT_0001' AS action_id, 'preview ' || arg_min(name, seq) AS name FROM v_actions WHERE record_type = 'scope' GROUP BY session_id)
  SELECT session_id, action_id, name FROM v_actions a WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.session_id = a.session_id AND n.action_id = a.action_id) UNION ALL SELECT * FROM n""")
_add("clear_session", lambda a: L.clear_sessions(a, a.where("record_type = 'smart_skip' AND k > 90")).groupBy("session_id").agg(F.count("*").alias("n")),
     "SELECT session_id, count(*) AS n FROM v_actions WHERE session_id NOT IN (SELECT session_id FROM v_actions WHERE record_type = 'smart_skip' AND k > 90) GROUP BY session_id")
