"""Chat, export, validation, evaluation and calculation queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.calculator import calculate
from millrace.operators import chat as H
from millrace.operators import evaluation as E
from millrace.operators import export as X
from millrace.operators import prompts as P
from millrace.plans import views as V

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


def _msgs(spark, sf):
    return V.table(spark, sf, "conversations")


@add("chat_history", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) SELECT conv_id, turn, role, text FROM x WHERE b <= 4 AND role <> 'system'")
def _(spark, sf):
    return H.history(_msgs(spark, sf), 4)


@add("chat_context", """WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS b, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn) AS f FROM conversations)
  SELECT conv_id, turn, role, text FROM x WHERE (role = 'system' AND f = 1) OR (role <> 'system' AND b <= 3)""")
def _(spark, sf):
    return H.context(_msgs(spark, sf), 3)


@add("chat_stats", "WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS users, sum(length(text)) AS chars FROM conversations GROUP BY conv_id) SELECT count(*) AS conversations, CAST(sum(n) AS BIGINT) AS messages, count(*) FILTER (n >= 4) AS long_ones, CAST(max(chars) AS BIGINT) AS most_chars FROM c")
def _(spark, sf):
    c = _msgs(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return c.agg(F.count("*").alias("conversations"), F.sum("n").alias("messages"), F.count_if(C("n") >= 4).alias("long_ones"), F.max("chars").alias("most_chars"))


_ROLES = "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'assistant' ELSE role END AS role, text FROM conversations"


def _mixed(spark, sf):
    return _msgs(spark, sf).withColumn("role", F.when(C("turn") % 3 == 0, "assistant").otherwise(C("role")))


@add("chat_merge_runs", f"""WITH m AS ({_ROLES}), c AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS ch FROM m),
  r AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c) SELECT conv_id, CAST(run AS BIGINT) AS run, role, string_agg(text, chr(10) ORDER BY turn) AS text, min(turn) AS turn, count(*) AS n FROM r GROUP BY conv_id, run, role""")
def _(spark, sf):
    return H.merge_runs(_mixed(spark, sf))


@add("chat_repair", f"""WITH m AS ({_ROLES}), x AS (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS f FROM m WHERE role <> 'system'),
  l AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS lead FROM x WHERE turn < f GROUP BY 1)
  SELECT conv_id, turn, role, CASE WHEN turn = f AND lead IS NOT NULL THEN lead || chr(10) || text ELSE text END AS text FROM x LEFT JOIN l USING (conv_id) WHERE turn >= f OR f IS NULL""")
def _(spark, sf):
    return H.user_first(_mixed(spark, sf))


@add("drop_leading_assistant", f"WITH m AS ({_ROLES}), x AS (SELECT *, min(turn) FILTER (role IN ('user', 'tool')) OVER (PARTITION BY conv_id) AS f FROM m) SELECT conv_id, turn, role, text FROM x WHERE role <> 'system' AND turn >= f")
def _(spark, sf):
    return H.drop_leading(_mixed(spark, sf))


_TAG = """'<think> ' || role || turn || ' </think>' || '<tool_call>{"name": "tool' || (turn % 3) || '", "arguments": {"k": ' || (conv_id % 5) || '}}</tool_call>' || CASE WHEN turn % 2 = 0 THEN '<tool_call>{"name": "tool' || (turn % 3) || '", "arguments": {"k": ' || (conv_id % 5) || '}}</tool_call>' ELSE '' END || text"""


def _tagged(spark, sf):
    return _msgs(spark, sf).withColumn("tagged", F.expr(_TAG))


@add("response_parse", f"WITH x AS (SELECT conv_id, turn, {_TAG} AS t FROM conversations) SELECT conv_id, turn, trim(regexp_extract(t, '(?s)<think>(.*?)</think>', 1)) AS think, trim(regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '(?s)<tool_call>.*?</tool_call>', '', 'g')) AS content, len(regexp_extract_all(t, '(?s)<tool_call>(.*?)</tool_call>', 1)) AS calls FROM x")
def _(spark, sf):
    r = H.parse_response(C("tagged"))
    return _tagged(spark, sf).select("conv_id", "turn", r["think"].alias("think"), r["content"].alias("content"), F.size(r["tool_names"]).cast("long").alias("calls"))


@add("tool_call_parse", f"WITH x AS (SELECT conv_id, turn, unnest(regexp_extract_all({_TAG}, '(?s)<tool_call>(.*?)</tool_call>', 1)) AS c FROM conversations) SELECT conv_id, turn, json_extract_string(c, '$.name') AS name, json_extract_string(c, '$.arguments.k') AS k, count(*) AS n FROM x GROUP BY ALL")
def _(spark, sf):
    calls = F.regexp_extract_all("tagged", F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    rows = _tagged(spark, sf).select("conv_id", "turn", F.explode(calls).alias("c"))
    parsed = F.from_json("c", "name string, arguments struct<k:string>")
    return rows.select("conv_id", "turn", parsed.alias("p")).groupBy("conv_id", "turn", C("p.name").alias("name"), C("p.arguments.k").alias("k")).agg(F.count("*").alias("n"))


@add("tool_call_dedup", f"WITH x AS (SELECT conv_id, turn, list_distinct(regexp_extract_all({_TAG}, '(?s)<tool_call>(.*?)</tool_call>', 1)) AS c FROM conversations) SELECT conv_id, turn, least(len(c), 10) AS calls FROM x")
def _(spark, sf):
    return _tagged(spark, sf).select("conv_id", "turn", F.size(H.tool_calls(C("tagged"))).cast("long").alias("calls"))


_RAW = """CASE turn % 5 WHEN 0 THEN 'left over</tool_response> ' || text WHEN 1 THEN '<tool_response>' || text || '</tool_response>' WHEN 2 THEN '<think> as ' || role || ' <tool_response>x</tool_response></think> ' || text || '</think></tool_response>'
  WHEN 3 THEN '<tool_call>{"name": "t"}</tool_call>' ELSE substring(text, 1, 30) END"""


def _raw(spark, sf):
    return _msgs(spark, sf).select("conv_id", "turn", F.expr(_RAW).alias("raw"))


_DONE = "'I have completed the requested operations. The data has been recorded successfully. Please check the session summary for details.'"


@add("reply_cleanup", f"""WITH r AS (SELECT conv_id, turn, {_RAW} AS t FROM conversations), b AS (SELECT conv_id, turn, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(t, '(?s)^[^<]*</tool_response>', '')), '(?s)<tool_response>.*?</tool_response>', '', 'g')), '</?tool_response>', '', 'g')) AS t FROM r),
  k AS (SELECT conv_id, turn, CASE WHEN length(t) < 50 AND NOT contains(t, '<think>') AND NOT contains(t, '<tool_call>') THEN {_DONE} ELSE t END AS t FROM b)
  SELECT conv_id, turn, trim(regexp_extract(t, '(?s)<think>(.*?)</think>', 1)) AS thinking,
  CASE WHEN regexp_matches(t, '(?s)<think>.*?</think>') THEN trim(regexp_replace(trim(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g')), '(?i)</think>', '', 'g')) ELSE t END AS reply FROM k""")
def _(spark, sf):
    return _raw(spark, sf).select("conv_id", "turn", H.cleaned(C("raw")).alias("c")).select("conv_id", "turn", "c.thinking", "c.reply")


_CALLED = """CASE turn % 4 WHEN 0 THEN '<tool_call>{"name": "record_flow", "arguments": 1}</tool_call>' WHEN 1 THEN '<think>only thoughts of ' || role WHEN 2 THEN '<think>a</think>' ELSE 'said: ' || role END"""


@add("reply_fallback", f"""WITH r AS (SELECT conv_id, turn, {_CALLED} AS t, conv_id % 3 AS m FROM conversations), c AS (SELECT *, trim(CASE WHEN contains(t, '</think>') THEN regexp_extract(t, '(?s)<think>(.*?)</think>', 1) WHEN contains(t, '<think>') THEN regexp_extract(t, '(?s)<think>(.*)$', 1) ELSE '' END) AS thinking,
  trim(regexp_replace(regexp_replace(CASE WHEN contains(t, '</think>') THEN regexp_replace(t, '(?s)<think>.*?</think>', '', 'g') WHEN contains(t, '<think>') THEN split_part(t, '<think>', 1) ELSE t END, '</?tool_call>?', '', 'g'), '\\{{"name":\\s*"[^"]*"[^}}]*\\}}?', '', 'g')) AS content FROM r)
  SELECT conv_id, turn, thinking, CASE WHEN content <> '' THEN content WHEN m = 0 THEN CASE WHEN thinking <> '' THEN 'I''ve analyzed your request. Please let me know if you need more details.' ELSE '' END
  WHEN m = 1 THEN 'I''ve processed your request. The data has been recorded successfully.'
  ELSE 'I''ve successfully recorded the data using 3 tool calls. The recorded items include: calculate, record_flow. Let me know if you need more details or want to extract additional data.' END AS content FROM c""".replace("\\\\", "\\"))
def _(spark, sf):
    call = lambda tool, result: F.struct(F.lit(tool).alias("tool_name"), F.lit(result).alias("result"))
    none, bad = F.array().cast("array<struct<tool_name:string,result:string>>"), F.array(call("search", "an error"))
    good = F.array(call("record_flow", "Recorded."), call("calculate", "SUCCESS"), call("record_flow", "success"))
    results = F.when(C("conv_id") % 3 == 0, none).when(C("conv_id") % 3 == 1, bad).otherwise(good)
    return _msgs(spark, sf).select("conv_id", "turn", H.with_fallback(F.expr(_CALLED), results).alias("c")).select("conv_id", "turn", "c.thinking", "c.content")


@add("chat_prompt_text", "SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) AS prompt, count(*) AS n FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return H.prompt(_msgs(spark, sf))


@add("reply_chunks", "SELECT conv_id, turn, CAST(ceil(length(text) / 50.0) AS BIGINT) AS pieces, substring(text, 51, 50) AS second FROM conversations")
def _(spark, sf):
    p = H.pieces(C("text"))
    return _msgs(spark, sf).select("conv_id", "turn", F.size(p).cast("long").alias("pieces"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("second"))


@add("think_split", f"WITH x AS (SELECT conv_id, turn, {_TAG} AS t FROM conversations) SELECT conv_id, turn, regexp_extract(t, '(?s)^<think>(.*?)</think>(.*)$', 1) AS thinking, regexp_extract(t, '(?s)^<think>(.*?)</think>(.*)$', 2) AS content FROM x")
def _(spark, sf):
    at = lambda i: F.regexp_extract("tagged", r"(?s)^<think>(.*?)</think>(.*)$", i)
    return _tagged(spark, sf).select("conv_id", "turn", at(1).alias("thinking"), at(2).alias("content"))


_SNAP = "SELECT conv_id, turn, substring(first_value(text) OVER (PARTITION BY conv_id ORDER BY turn), 1, CAST((turn + 1) * 20 AS INTEGER)) AS text FROM conversations"


def _snapshots(spark, sf):
    first = F.first("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return _msgs(spark, sf).select("conv_id", "turn", F.substring(first, F.lit(1), ((C("turn") + 1) * 20).cast("int")).alias("text"))


@add("delta_stream", f"WITH s AS ({_SNAP}), x AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS b FROM s) SELECT conv_id, turn, text, CASE WHEN starts_with(text, b) THEN substring(text, length(b) + 1) ELSE text END AS delta FROM x")
def _(spark, sf):
    return H.deltas(_snapshots(spark, sf))


@add("distinct_until_changed", f"WITH s AS ({_SNAP}), x AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM s) SELECT conv_id, turn, text FROM x WHERE text IS DISTINCT FROM b")
def _(spark, sf):
    return H.changes(_snapshots(spark, sf))


@add("session_tag", "SELECT conv_id, turn, regexp_extract('[PDF_SESSION_ID:s' || conv_id || '] ' || text, '^\\[PDF_SESSION_ID:([^\\]]*)\\]', 1) AS session_id FROM conversations")
def _(spark, sf):
    t = F.concat(F.lit("[PDF_SESSION_ID:s"), C("conv_id").cast("string"), F.lit("] "), "text")
    return _msgs(spark, sf).select("conv_id", "turn", H.session_tag(t).alias("session_id"))


@add("sse_decode", "SELECT conv_id, turn, 'message' AS event, role AS kind, length(text) AS n FROM conversations")
def _(spark, sf):
    sent = H.sse(F.lit("message"), F.to_json(F.struct(C("role").alias("kind"), "text")))
    rows = _msgs(spark, sf).select("conv_id", "turn", H.sse_parts(sent).alias("p"))
    rows = rows.select("conv_id", "turn", "p.event", F.from_json("p.data", "kind string, text string").alias("d"))
    return rows.select("conv_id", "turn", "event", "d.kind", F.length("d.text").cast("long").alias("n"))


_TOLD = """CASE turn % 6 WHEN 0 THEN '{"results": [{"chunk_id": "c1", "content": "one"}, {"chunk_id": "c2", "content": "two"}]}' WHEN 1 THEN '{"results": []}' WHEN 2 THEN '{"data": {"action_id": "ACT_0007", "parameter_name": "System Boundary"}}'
  WHEN 3 THEN '{"completeness_score": 70, "session_id": "s1"}' WHEN 4 THEN text ELSE '{"data": {}}' END"""
_TOOL = "CASE turn % 6 WHEN 0 THEN 'search_document' WHEN 1 THEN 'search_document' WHEN 2 THEN 'define_lca_scope' WHEN 3 THEN 'process_document' WHEN 4 THEN 'search_document' ELSE 'record_process_flow' END"


@add("tool_response_summary", """SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'Found 2 chunks:' || chr(10) || '  - Chunk c1: one' || chr(10) || '  - Chunk c2: two' WHEN 1 THEN 'No results found' WHEN 2 THEN 'Scope defined: System Boundary, action_id: ACT_0007'
  WHEN 3 THEN 'Document processed successfully, session: s1' WHEN 4 THEN substring(text, 1, 500) ELSE 'Flow recorded successfully, action_id: unknown' END AS summary FROM conversations""")
def _(spark, sf):
    return _msgs(spark, sf).select("conv_id", "turn", P.response_summary(F.expr(_TOOL), F.expr(_TOLD)).alias("summary"))


@add("agent_history", """WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND text <> '' THEN '**User**: ' || CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END
  WHEN role = 'assistant' THEN CASE WHEN turn % 3 = 0 THEN '**Your Previous Reasoning**: so then' || chr(10) || chr(10) ELSE '' END || '**Your Previous Action**: Record parameter: p' || turn || ' = 3 kg' END AS line FROM conversations)
  SELECT conv_id, coalesce(string_agg(line, chr(10) || chr(10) ORDER BY turn), '(No previous actions)') AS history FROM m GROUP BY conv_id""")
def _(spark, sf):
    rows = _msgs(spark, sf).withColumns({
        "content": C("text"), "name": F.lit(None).cast("string"), "reasoning": F.when(C("turn") % 3 == 0, "so [SMART_SKIP_PLACEHOLDER:7]then"),
        "tool_calls": F.concat(F.lit('[{"name": "record_parameter", "arguments": {"parameter_name": "p'), C("turn").cast("string"), F.lit('", "value": 3, "unit": "kg"}}]')),
    })
    return P.conversation_history(rows)


# --- export, validation, split --------------------------------------------------------------------------------------
@add("token_stats", "WITH t AS (SELECT source, CASE WHEN length(text) > 0 THEN greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) ELSE 0 END AS n FROM documents) SELECT source, count(*) AS files, min(n) AS least, max(n) AS most, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, count(*) FILTER (n > 8192) AS over_8192, count(*) FILTER (n > 16384) AS over_16384, count(*) FILTER (n > 32768) AS over_32768 FROM t GROUP BY source")
def _(spark, sf):
    rows, n = V.table(spark, sf, "documents").select("source", H.tokens(C("text")).alias("n")), C("n")
    return rows.groupBy("source").agg(F.count("*").alias("files"), F.min(n).alias("least"), F.max(n).alias("most"), F.sum(n).alias("total"), F.round(F.avg(n), 6).alias("mean"), F.count_if(n > 8192).alias("over_8192"), F.count_if(n > 16384).alias("over_16384"), F.count_if(n > 32768).alias("over_32768"))


@add("token_top20", "SELECT doc_id, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS n FROM documents ORDER BY n DESC, doc_id LIMIT 20")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", H.tokens(C("text")).alias("n")).orderBy(F.desc("n"), "doc_id").limit(20)


@add("train_eval_split", """WITH c AS (SELECT conv_id, CASE WHEN count(*) >= 5 THEN 'FULL' WHEN conv_id % 2 = 0 THEN 'SHORT_E' ELSE 'SHORT_QA' END AS kind FROM conversations GROUP BY 1), x AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('42:' || conv_id)) AS r FROM c)
  SELECT conv_id, kind, CASE WHEN r <= CASE kind WHEN 'FULL' THEN 3 WHEN 'SHORT_E' THEN 4 ELSE 5 END THEN 'eval' ELSE 'train' END AS part FROM x""")
def _(spark, sf):
    kind = F.when(F.count("*") >= 5, "FULL").when(C("conv_id") % 2 == 0, "SHORT_E").otherwise("SHORT_QA")
    c = _msgs(spark, sf).groupBy("conv_id").agg(kind.alias("kind"))
    return H.split_sample(c, "kind", F.md5(F.concat(F.lit("42:"), C("conv_id").cast("string")).cast("binary")))


@add("sample_files", "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id) LIMIT 10")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("7:"), C("doc_id").cast("string")).cast("binary"))).limit(10)


_FAULT_COLUMNS = {
    "sample": "conv_id", "place": "turn", "role": "CASE WHEN turn % 6 = 5 THEN 'tool' ELSE role END",
    "content": "CASE WHEN (conv_id + turn) % 7 = 0 THEN '' WHEN (conv_id + turn) % 11 = 0 THEN NULL ELSE text END",
    "reasoning": "CASE turn % 5 WHEN 1 THEN concat('Sorry, I COULDN', chr(39), 'T FIND any') WHEN 2 THEN '[SMART_SKIP_PLACEHOLDER:3]' WHEN 3 THEN '' WHEN 4 THEN 'because' END",
    "tool_calls": """CASE (conv_id + turn) % 6 WHEN 0 THEN '[{"name": "record_parameter", "arguments": {"k": 1}}]' WHEN 1 THEN '[{"arguments": {"k": 1}}, {"name": "search"}]' WHEN 2 THEN '[]'
      WHEN 3 THEN '[{"name": "define_lca_scope", "arguments": "k"}, {"name": "x", "arguments": [1]}]' WHEN 4 THEN '["record_parameter"]' END""",
}
_FAULTS = "SELECT " + ", ".join(f"{e} AS {name}" for name, e in _FAULT_COLUMNS.items())


def _faulty(spark, sf):
    return _msgs(spark, sf).selectExpr(*[f"{e} AS {name}" for name, e in _FAULT_COLUMNS.items()])


_ISSUES = f"""WITH m AS ({_FAULTS} FROM conversations), e AS (SELECT *, coalesce(content, '') = '' AS ec, coalesce(reasoning, '') = '' AS er, coalesce(tool_calls, '[]') <> '[]' AS called, role = 'assistant' AS a FROM m),
c AS (SELECT sample, place, CAST(i AS INTEGER) AS call, json_extract(tool_calls, '$[' || i || ']') AS c FROM (SELECT *, unnest(range(CAST(json_array_length(tool_calls) AS BIGINT))) AS i FROM e WHERE a AND called)),
i AS (SELECT sample, place, CAST(NULL AS INTEGER) AS call, unnest([CASE WHEN a AND called AND er THEN 'missing_reasoning' END, CASE WHEN a AND NOT called AND ec THEN 'missing_content' END,
  CASE WHEN a AND called AND contains(lower(reasoning), 'couldn''t find') AND json_extract_string(tool_calls, '$[0].name') IN ('record_process_flow', 'record_parameter', 'define_lca_scope') THEN 'reasoning_action_mismatch' END,
  CASE WHEN a AND contains(reasoning, '[SMART_SKIP_PLACEHOLDER') THEN 'placeholder_not_replaced' END, CASE WHEN a AND tool_calls = '[]' THEN 'empty_tool_calls' END,
  CASE WHEN role = 'tool' AND ec THEN 'empty_tool_response' END, CASE WHEN role = 'user' AND ec AND place > 0 THEN 'empty_user_content' END]) AS issue FROM e
UNION ALL SELECT sample, place, call, unnest(CASE WHEN json_type(c) <> 'OBJECT' THEN ['invalid_tool_call'] ELSE [CASE WHEN NOT json_exists(c, '$.name') THEN 'missing_tool_name' END,
  CASE WHEN NOT json_exists(c, '$.arguments') THEN 'missing_tool_args' WHEN json_type(c, '$.arguments') <> 'OBJECT' THEN 'invalid_tool_args' END] END) FROM c)"""


@add("training_validation", _ISSUES + " SELECT * FROM i WHERE issue IS NOT NULL")
def _(spark, sf):
    return H.validate(_faulty(spark, sf))


@add("issue_counts", _ISSUES + " SELECT issue, count(*) AS n, count(DISTINCT sample) AS samples FROM i WHERE issue IS NOT NULL GROUP BY issue")
def _(spark, sf):
    return H.validate(_faulty(spark, sf)).groupBy("issue").agg(F.count("*").alias("n"), F.countDistinct("sample").alias("samples"))


@add("validation_report", _ISSUES + """, b AS (SELECT DISTINCT sample FROM i WHERE issue IS NOT NULL), s AS (SELECT DISTINCT conv_id FROM conversations)
  SELECT count(*) AS files, count(sample) AS files_with_issues, round(100 * (1 - count(sample) / greatest(count(*), 1)), 1) AS pass_rate FROM s LEFT JOIN b ON sample = conv_id""")
def _(spark, sf):
    return H.validation_report(_msgs(spark, sf).select(C("conv_id").alias("sample")), H.validate(_faulty(spark, sf)), "sample")


_FILE = """CASE event_id % 5 WHEN 0 THEN substring(props, 2) WHEN 1 THEN '[' || props || ']' WHEN 2 THEN '{"messages": [' || props || ']}' ELSE props END"""


@add("file_validation", f"SELECT event_id AS file, CASE WHEN event_id % 5 = 0 THEN 'json_error' ELSE 'format_error' END AS issue FROM events WHERE event_id % 5 NOT IN (1, 2)")
def _(spark, sf):
    return H.validate_files(V.table(spark, sf, "events").select(C("event_id").alias("file"), F.expr(_FILE).alias("content")))


@add("message_cleaning", f"WITH m AS ({_FAULTS} FROM conversations) SELECT sample, place, role, nullif(trim(content), '') AS content, reasoning, nullif(tool_calls, '[]') AS tool_calls FROM m")
def _(spark, sf):
    return _faulty(spark, sf).select("sample", "place", "role", F.nullif(F.trim("content"), F.lit("")).alias("content"), "reasoning", F.nullif("tool_calls", F.lit("[]")).alias("tool_calls"))


def _log(spark, sf):
    """The action log with what tools were given: previews, summaries, a type that no tool makes, chunks and calculations."""
    a, seq, k = V.actions(spark, sf), C("seq"), C("k")
    aside = C("intent").isin("pivot_query", "smart_skip")
    kind = F.when(seq == 2, "document_preview").when(aside, C("record_type")).when(seq % 11 == 0, "summary_check").when(seq % 13 == 0, "note").otherwise(C("record_type"))
    chunk = F.struct("chunk_id", F.concat(F.lit('text "of" '), "chunk_id").alias("content"))
    chunks = F.when(C("chunk_id").isNotNull(), F.array(chunk)).otherwise(F.array().cast("array<struct<chunk_id:string,content:string>>"))
    asked = F.when(k % 3 == 0, F.array("search_query", "category")).otherwise(F.array("search_query"))
    content = lambda x: F.struct(F.lit(x).alias("chunk_id"), F.when(C("session_id") != "S1", F.concat(F.lit(f"page {x} of "), "session_id")).alias("content"))
    value = F.floor("value") + F.lit(0.5)
    return a.select(
        "session_id", seq, "action_id", kind.alias("record_type"), F.when(seq != 2, C("intent")).alias("intent"), "link_to", "category", "name", value.alias("value"), F.lit("kg").alias("unit"),
        F.when(C("category").isin(*V.INPUTS), "Input").otherwise("Output").alias("flow_type"), F.when(k % 4 == 0, "measured").when(k % 4 == 1, "").alias("note"), "process_name",
        F.lit(None).cast("string").alias("cas_number"), F.when(k % 5 == 0, "GLO").alias("location"), C("name").alias("parameter_name"), value.alias("parameter_value"), F.when(k % 2 == 0, "kWh").alias("parameter_unit"),
        F.when(k % 3 > 0, F.concat(F.lit("about "), "name")).otherwise("").alias("description"), F.concat(F.lit("line\n"), "name").alias("source_content"), F.concat("name", F.lit(" * 2")).alias("calculation_expression"),
        (value * 2).alias("calculation_result"), F.when(k % 2 == 0, "kWh").alias("calculation_unit"), F.when(C("link_to").isNotNull(), F.array("link_to")).alias("data_dependencies"),
        asked.alias("search_query"), chunks.alias("search_context"), F.when(C("chunk_id").isNotNull(), chunk).alias("selected_chunk"), asked.alias("failed_query"), chunks.alias("failed_context"),
        F.when(k % 2 == 0, "duplicate").alias("skip_reason"), F.when(k % 7 > 0, F.struct(F.lit("skipped").alias("chunk_id"), C("name").alias("content"))).alias("skipped_chunk"),
        F.when(k % 2 == 0, F.concat(F.lit("doc "), "session_id")).alias("document_name"), F.struct(content("0").alias("chunk_0"), content("1").alias("chunk_1")).alias("document_preview"),
    )


def _j(x):
    return f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"


def _said(key, x):
    return f"CASE WHEN coalesce({x}, '') <> '' THEN ',\"{key}\":' || {_j(x)} ELSE '' END"


_CH = "'{\"chunk_id\":' || " + _j("chunk_id") + " || ',\"content\":' || " + _j("'text \"of\" ' || chunk_id") + " || '}'"
_LOG = f"""{V.ACTIONS}, lg AS (SELECT session_id, seq, action_id, CASE WHEN seq = 2 THEN 'document_preview' WHEN intent IN ('pivot_query', 'smart_skip') THEN record_type WHEN seq % 11 = 0 THEN 'summary_check' WHEN seq % 13 = 0 THEN 'note' ELSE record_type END AS record_type,
  CASE WHEN seq <> 2 THEN intent END AS intent, link_to, category, name, floor(value) + 0.5::DOUBLE AS value, k, chunk_id, process_name, CASE WHEN category IN ('Raw Material', 'Process Energy', 'Post-processing Energy', 'Feedstock Energy', 'Gas', 'Cooling Media') THEN 'Input' ELSE 'Output' END AS flow_type,
  CASE WHEN k % 4 = 0 THEN 'measured' WHEN k % 4 = 1 THEN '' END AS note, CASE WHEN k % 5 = 0 THEN 'GLO' END AS location, CASE WHEN k % 3 > 0 THEN 'about ' || name ELSE '' END AS description, CASE WHEN k % 2 = 0 THEN 'kWh' END AS unit2,
  CASE WHEN k % 3 = 0 THEN [search_query, category] ELSE [search_query] END AS asked, CASE WHEN chunk_id IS NOT NULL THEN [struct_pack(a := chunk_id, b := 'text "of" ' || chunk_id)] ELSE [] END AS found, CASE WHEN k % 7 > 0 THEN name END AS skipped,
  CASE WHEN k % 2 = 0 THEN 'duplicate' ELSE 'already_recorded' END AS reason FROM v_actions)"""
_KINDS = "CASE WHEN record_type = 'pivot' OR intent = 'pivot_query' THEN 'pivot' WHEN intent = 'smart_skip' THEN 'skip' ELSE 'record' END AS kind"
_SEARCH = f"""'{{"name":"search_document","arguments":{{"session_id":' || {_j('session_id')} || CASE WHEN len(asked) > 1 THEN ',"queries":[' || array_to_string(list_transform(asked, lambda x: {_j('x')}), ',') || ']' ELSE ',"query":' || {_j('asked[1]')} END || '}}}}'"""
_FOUND = f"""'<tool_response>
{{
  "success": true,
  "message": "Found ' || len(found) || ' relevant results",
  "results": ' || CASE WHEN len(found) > 0 THEN '[
    ' || array_to_string(list_transform(found, lambda c: '{{
      "chunk_id": ' || {_j('c.a')} || ',
      "content": ' || {_j('c.b')} || '
    }}'), ',
    ') || '
  ]' ELSE '[]' END || ',
' || CASE WHEN len(asked) > 1 THEN '  "queries": [
    ' || array_to_string(list_transform(asked, lambda x: {_j('x')}), ',
    ') || '
  ]' ELSE '  "query": ' || {_j('asked[1]')} END || '
}}
</tool_response>'"""
_OPEN = "'{{\"name\":\"{0}\",\"arguments\":{{\"session_id\":' || " + _j("session_id")
_CALL = f"""CASE record_type WHEN 'parameter' THEN {_OPEN.format('record_parameter')} || ',"parameter_name":' || {_j('name')} || ',"parameter_value":' || {_j('value')} || ',"parameter_unit":' || {_j('unit2')} || ',"selected_chunk":' || {_CH} || {_said('note', 'note')}
  WHEN 'flow' THEN {_OPEN.format('record_process_flow')} || ',"flow_type":' || {_j('flow_type')} || ',"category":' || {_j('category')} || ',"name":' || {_j('name')} || ',"value":' || {_j('value')} || ',"unit":"kg","selected_chunk":' || {_CH} || {_said('note', 'note')} || {_said('process_name', 'process_name')} || {_said('location', 'location')}
  WHEN 'calculation' THEN {_OPEN.format('execute_calculation')} || ',"expression":' || {_j("name || ' * 2'")} || ',"dependencies":[' || coalesce(CAST(to_json(link_to) AS VARCHAR), '') || ']'
  WHEN 'scope' THEN {_OPEN.format('define_lca_scope')} || ',"parameter_name":' || {_j('name')} || ',"description":' || {_j('description')} || ',"value":' || {_j('value')} || ',"unit":"kg","source_content":' || {_j("'line' || chr(10) || name")} || ',"selected_chunk":' || {_CH} || {_said('note', 'note')}
  ELSE {_OPEN.format('get_session_summary')} || ',"format":"text"' END || '}}}}'"""
_OWN = f"""'{{
    "record_id": ' || {_j("session_id || '/' || action_id")} || ',
    "action_id": ' || {_j('action_id')} || ',
    "session_id": ' || {_j('session_id')} || ',
'"""
_ANSWER = f"""'<tool_response>
{{
  "success": true,
' || CASE record_type WHEN 'parameter' THEN '  "message": "Parameter recorded with action_id: ' || action_id || '",
  "new_action_id": ' || {_j('action_id')} WHEN 'flow' THEN '  "message": ' || {_j("'Successfully recorded process flow: ' || name")} || ',
  "data": ' || {_OWN} || '    "flow_type": ' || {_j('flow_type')} || ',
    "category": ' || {_j('category')} || ',
    "name": ' || {_j('name')} || ',
    "value": ' || {_j('value')} || ',
    "unit": "kg"
  }}' WHEN 'calculation' THEN '  "message": "Calculation executed successfully",
  "result": ' || {_j('value * 2')} || ',
  "unit": ' || {_j('unit2')} WHEN 'scope' THEN '  "message": ' || {_j("'Successfully defined LCA scope: ' || name")} || ',
  "data": ' || {_OWN} || '    "parameter_name": ' || {_j('name')} || '
  }}' ELSE '  "summary": ' || {_j('summary')} END || '
}}
</tool_response>'"""
_MESSAGES = f"""sm0 AS (SELECT a.session_id, a.seq, count(b.seq) AS n, list(b.name || ': ' || b.description ORDER BY b.seq) FILTER (b.record_type = 'scope') AS sc,
  list(b.name || ': ' || CAST(b.value AS VARCHAR) || ' kg (' || b.flow_type || '/' || b.category || ')' ORDER BY b.seq) FILTER (b.record_type = 'flow') AS fl, list(b.name || ': ' || CAST(b.value AS VARCHAR) || ' ' || coalesce(b.unit2, '') ORDER BY b.seq) FILTER (b.record_type = 'parameter') AS pa
  FROM lg a LEFT JOIN lg b ON a.session_id = b.session_id AND b.seq < a.seq WHERE a.record_type = 'summary_check' GROUP BY ALL),
sm1 AS (SELECT session_id, seq, n, coalesce(len(sc), 0) AS s, coalesce(len(fl), 0) AS f, coalesce(len(pa), 0) AS p, sc, fl, pa FROM sm0),
sm AS (SELECT session_id, seq, CASE WHEN n = 0 THEN 'No previous records in this session.' ELSE rtrim('Total Actions: ' || (s + f + p) || chr(10) || 'Scopes: ' || s || ', Flows: ' || f || ', Parameters: ' || p || chr(10) ||
  CASE WHEN s > 0 THEN chr(10) || 'LCA Scope:' || chr(10) || '  - ' || array_to_string(sc, chr(10) || '  - ') || chr(10) ELSE '' END || CASE WHEN f > 0 THEN chr(10) || 'Recorded Flows:' || chr(10) || '  - ' || array_to_string(fl, chr(10) || '  - ') || chr(10) ELSE '' END ||
  CASE WHEN p > 0 THEN chr(10) || 'Recorded Parameters:' || chr(10) || '  - ' || array_to_string(pa, chr(10) || '  - ') || chr(10) ELSE '' END, '') END AS summary FROM sm1),
t0 AS (SELECT *, {_KINDS} FROM lg WHERE record_type <> 'document_preview'),
t1 AS (SELECT * REPLACE (CASE WHEN kind = 'skip' AND len(found) = 0 AND skipped IS NOT NULL THEN [struct_pack(a := 'skipped', b := skipped)] ELSE found END AS found) FROM t0),
t2 AS (SELECT *, CASE WHEN kind <> 'record' OR len(found) > 0 THEN asked END AS may FROM t1),
t3 AS (SELECT *, last_value(may IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was, kind = 'record' AND record_type <> 'note' AS records FROM t2),
t4 AS (SELECT *, may IS NOT NULL AND may IS DISTINCT FROM was AS searches FROM t3), t5 AS (SELECT *, CASE WHEN searches OR records THEN kind END AS speaks, '[SMART_SKIP_PLACEHOLDER: ' || category || ' - ' || reason || ']' AS ph FROM t4),
t6 AS (SELECT *, last_value(CASE WHEN speaks IS NOT NULL THEN CASE WHEN kind = 'skip' THEN ph ELSE '' END END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pending,
  first_value(speaks IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM t5),
t AS (SELECT t6.*, summary, CASE WHEN kind = 'pivot' THEN '' ELSE coalesce(pending, '') END AS takes FROM t6 LEFT JOIN sm USING (session_id, seq)), nul AS (SELECT CAST(NULL AS VARCHAR) AS x),
en AS (SELECT session_id, max(seq) AS seq, arg_max(record_type, seq) AS kind, count(*) AS n FROM t GROUP BY 1),
m AS (SELECT session_id, seq, 0 AS k, 'assistant' AS role, x AS content, takes AS reasoning_content, '[' || {_SEARCH} || ']' AS tool_calls FROM t, nul WHERE searches
  UNION ALL SELECT session_id, seq, 1, 'tool', {_FOUND}, NULL, NULL FROM t WHERE searches UNION ALL SELECT session_id, seq, 2, 'assistant', NULL, ph, '[]' FROM t WHERE kind = 'skip' AND searches AND coalesce(next, 'pivot') = 'pivot'
  UNION ALL SELECT session_id, seq, 3, 'assistant', NULL, CASE WHEN searches THEN '' ELSE takes END, '[' || {_CALL} || ']' FROM t WHERE records UNION ALL SELECT session_id, seq, 4, 'tool', {_ANSWER}, NULL, NULL FROM t WHERE records
  UNION ALL SELECT session_id, seq, 5, 'assistant', '', '', NULL FROM en WHERE kind = 'summary_check' OR (kind IN ('parameter', 'flow', 'calculation', 'scope') AND n <= 5))"""


def _flat(calls):
    return F.when(calls.isNotNull(), F.concat(F.lit("["), F.array_join(calls, ","), F.lit("]")))


@add("export_chat", f"WITH {_LOG}, {_MESSAGES} SELECT * FROM m")
def _(spark, sf):
    return X.chat_rows(_log(spark, sf)).withColumn("tool_calls", _flat(C("tool_calls")))


_BASE = "You are a life cycle inventory expert."
_PROMPT = f"""pr0 AS (SELECT session_id, arg_min(k, seq) FILTER (record_type = 'document_preview') AS k FROM lg GROUP BY 1),
pr AS (SELECT session_id, '{_BASE}' || CASE WHEN k IS NULL THEN '' ELSE chr(10) || chr(10) || '**DOCUMENT CONTEXT**: ' || chr(10) || 'A PDF document has been uploaded and is ready for analysis.' || chr(10) || '- Document Name: "' || CASE WHEN k % 2 = 0 THEN 'doc ' || session_id ELSE 'Unknown Document' END ||
  '"' || chr(10) || '- Document ID: ' || session_id[1:8] || '...' || chr(10) || CASE WHEN session_id = 'S1' THEN '' ELSE chr(10) || '**CHUNK 0 PREVIEW** (Executive Summary / Introduction):' || chr(10) || '"page 0 of ' || session_id || '"' || chr(10) || chr(10) || '**CHUNK 1 PREVIEW**:' || chr(10) || '"page 1 of ' || session_id || '"' || chr(10) END ||
  '{{injection}}' END AS prompt FROM pr0)"""


@add("system_prompts", f"WITH {_LOG}, " + _PROMPT.format(injection=X.INJECTION) + " SELECT * FROM pr")
def _(spark, sf):
    return X.system_prompts(_log(spark, sf), _BASE)


def _lines(samples):
    """Messages as text: a line of role, reasoning, calls and content each."""
    line = lambda m: F.concat_ws("|", m["role"], F.coalesce(m["reasoning_content"], F.lit("-")), F.coalesce(_flat(m["tool_calls"]), F.lit("-")), F.coalesce(m["content"], F.lit("-")))
    return samples.select("session_id", "n", F.md5(F.array_join(F.transform("messages", line), "\n").cast("binary")).alias("digest"))


_DIGEST = """, al AS (SELECT session_id, seq, k, role, content, reasoning_content, tool_calls FROM m UNION ALL SELECT session_id, -1, -2, 'system', prompt, NULL, NULL FROM pr UNION ALL SELECT session_id, -1, -1, 'user', '', NULL, NULL FROM pr)
  SELECT session_id, count(*) AS n, md5(string_agg(role || '|' || coalesce(reasoning_content, '-') || '|' || coalesce(tool_calls, '-') || '|' || coalesce(content, '-'), chr(10) ORDER BY seq, k)) AS digest FROM al GROUP BY session_id"""


@add("export_chat_samples", f"WITH {_LOG}, {_MESSAGES}, " + _PROMPT.format(injection=X.INJECTION) + _DIGEST)
def _(spark, sf):
    return _lines(X.chat_samples(_log(spark, sf), _BASE))


_QA_TOLD = f"""u0 AS (SELECT *, {_KINDS} FROM lg WHERE record_type <> 'document_preview'), u1 AS (SELECT * REPLACE (CASE WHEN kind <> 'skip' THEN found WHEN skipped IS NOT NULL THEN [struct_pack(a := 'skipped', b := skipped)] ELSE [] END AS found) FROM u0),
u AS (SELECT *, asked IS DISTINCT FROM lag(asked) OVER (PARTITION BY session_id ORDER BY seq) AS searches FROM u1),
r AS (SELECT a.*, EXISTS (SELECT 1 FROM u c WHERE c.session_id = a.session_id AND c.action_id = a.link_to AND c.record_type = 'calculation' AND c.kind = 'record' AND c.seq < a.seq) AS calculated FROM u a WHERE a.kind = 'record' AND a.record_type IN ('flow', 'scope', 'parameter')),
ra AS (SELECT session_id, seq, CASE record_type WHEN 'scope' THEN 'The functional unit is: ' || coalesce(nullif(description, ''), name) WHEN 'parameter' THEN 'The ' || lower(name) || ' is ' || CAST(value AS VARCHAR) || ' kg.' ELSE
  CASE WHEN calculated THEN 'Based on the calculation, the ' || lower(name) || ' is ' || CAST(value AS VARCHAR) || ' kg.' WHEN flow_type = 'Input' THEN 'The process consumed ' || CAST(value AS VARCHAR) || ' kg of ' || lower(name) || '.'
  WHEN category = 'Product' THEN 'The process produced ' || CAST(value AS VARCHAR) || ' kg of ' || lower(name) || '.' WHEN category = 'Waste' THEN 'The process generated ' || CAST(value AS VARCHAR) || ' kg of ' || lower(name) || ' waste.'
  WHEN category = 'Emission' THEN 'The process emitted ' || CAST(value AS VARCHAR) || ' kg of ' || lower(name) || '.' ELSE 'The output is ' || CAST(value AS VARCHAR) || ' kg of ' || lower(name) || '.' END END AS answer FROM r),
m AS (SELECT session_id, seq, 0 AS k, 'assistant' AS role, CAST(NULL AS VARCHAR) AS content, '' AS reasoning_content, '[' || {_SEARCH} || ']' AS tool_calls FROM u WHERE searches UNION ALL SELECT session_id, seq, 1, 'tool', {_FOUND}, NULL, NULL FROM u WHERE searches
  UNION ALL SELECT session_id, (SELECT max(seq) FROM lg l WHERE l.session_id = ra.session_id), 5, 'assistant', string_agg(answer, ' ' ORDER BY seq), '', NULL FROM ra GROUP BY session_id)"""


@add("export_qa_chat", f"WITH {_LOG}, {_QA_TOLD} SELECT * FROM m")
def _(spark, sf):
    return X.qa_rows(_log(spark, sf)).withColumn("tool_calls", _flat(C("tool_calls")))


@add("export_qa_samples", f"WITH {_LOG}, {_QA_TOLD}, " + _PROMPT.format(injection=X.QA_INJECTION) + _DIGEST)
def _(spark, sf):
    return _lines(X.qa_samples(_log(spark, sf), _BASE))


_QUERIES = {
    "Raw Material": "powder material feedstock", "Process Energy": "energy electricity power consumption", "Post-processing Energy": "heat treatment machining post-processing energy", "Feedstock Energy": "powder production atomization feedstock energy",
    "Gas": "gas argon nitrogen shielding", "Cooling Media": "water cooling liquid coolant", "Product": "product part manufactured output", "Recovered Material": "recovered reuse recycled powder", "Waste": "waste scrap trimmings dust disposal", "Emission": "emissions CO2 exhaust gas",
}


@add("category_queries", f"WITH {V.ACTIONS}, x AS (SELECT CASE WHEN k % 11 = 0 THEN 'other' ELSE category END AS category FROM v_actions) SELECT category, CASE category " + " ".join(f"WHEN '{c}' THEN '{q}'" for c, q in _QUERIES.items()) + " END AS query, count(*) AS n FROM x GROUP BY ALL")
def _(spark, sf):
    category = F.when(C("k") % 11 == 0, "other").otherwise(C("category"))
    return V.actions(spark, sf).groupBy(category.alias("category")).agg(F.count("*").alias("n")).select("category", X.category_query(C("category")).alias("query"), "n")


@add("export_qa", f"""WITH {V.ACTIONS}, r AS (SELECT r.*, c.action_id IS NOT NULL AS calculated, CASE WHEN r.k % 13 = 0 THEN '' WHEN r.category IN ('Raw Material', 'Process Energy', 'Post-processing Energy', 'Feedstock Energy', 'Gas', 'Cooling Media') THEN 'Input' ELSE 'Output' END AS flow_type,
  CAST(floor(r.value) AS BIGINT) || ' kg' AS amount FROM v_actions r LEFT JOIN v_actions c ON c.session_id = r.session_id AND c.action_id = r.link_to AND c.record_type = 'calculation' AND c.seq < r.seq WHERE r.record_type IN ('flow', 'scope', 'parameter'))
  SELECT session_id, action_id, calculated, CASE WHEN record_type = 'scope' THEN 'The functional unit is: ' || name WHEN record_type = 'parameter' THEN 'The ' || name || ' is ' || amount || '.' WHEN calculated THEN 'Based on the calculation, the ' || name || ' is ' || amount || '.'
  WHEN flow_type = 'Input' THEN 'The process consumed ' || amount || ' of ' || name || '.' WHEN flow_type = '' THEN 'The ' || name || ' is ' || amount || '.' WHEN category = 'Product' THEN 'The process produced ' || amount || ' of ' || name || '.'
  WHEN category = 'Waste' THEN 'The process generated ' || amount || ' of ' || name || ' waste.' WHEN category = 'Emission' THEN 'The process emitted ' || amount || ' of ' || name || '.' ELSE 'The output is ' || amount || ' of ' || name || '.' END AS answer FROM r""")
def _(spark, sf):
    side = F.when(C("k") % 13 == 0, "").when(C("category").isin(*V.INPUTS), "Input").otherwise("Output")
    rows = V.actions(spark, sf).withColumns({"value": F.floor("value").cast("long"), "unit": F.lit("kg"), "flow_type": side, "parameter_name": C("name"), "description": F.lit("")})
    return X.qa_pairs(rows).select("session_id", "action_id", "calculated", "answer")


@add("ground_truth_records", f"WITH {V.ACTIONS} SELECT session_id AS file, category, count(*) AS records, CAST(sum(k) AS BIGINT) AS total FROM v_actions WHERE record_type = 'flow' GROUP BY ALL")
def _(spark, sf):
    rows = V.actions(spark, sf).groupBy(C("session_id").alias("file")).agg(F.collect_list(F.when(C("record_type") == "flow", F.struct("category", "k"))).alias("records"))
    return rows.select("file", F.inline("records")).groupBy("file", "category").agg(F.count("*").alias("records"), F.sum("k").alias("total"))


@add("records_by_type", f"WITH {V.ACTIONS} SELECT record_type, count(DISTINCT session_id) AS files, count(*) AS records FROM v_actions GROUP BY record_type")
def _(spark, sf):
    return V.actions(spark, sf).groupBy("record_type").agg(F.countDistinct("session_id").alias("files"), F.count("*").alias("records"))


# --- evaluation ------------------------------------------------------------------------------------------------------
@add("eval_prf", """WITH x AS (SELECT lang, quality = 1 AS t, n_chars > 800 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM x GROUP BY lang),
  r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM c) SELECT lang, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM r""")
def _(spark, sf):
    pairs = V.table(spark, sf, "labels").join(V.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return E.prf(pairs, ["lang"], C("n_chars") > 800, C("quality") == 1)


_PAIR = "SELECT l_orderkey AS file, l_partkey AS place, 'Part ' || (l_partkey % 9) AS name, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity END AS truth, CASE WHEN l_linenumber = 1 THEN l_discount / 5 ELSE l_quantity * (1 + l_discount / 5) END AS predicted, l_suppkey FROM lineitem"


def _pairs(spark, sf):
    one = C("l_linenumber") == 1
    return V.table(spark, sf, "lineitem").select(
        C("l_orderkey").alias("file"), C("l_partkey").alias("place"), F.concat(F.lit("Part "), (C("l_partkey") % 9).cast("string")).alias("name"),
        F.when(one, 0.0).otherwise(C("l_quantity")).alias("truth"), F.when(one, C("l_discount") / 5).otherwise(C("l_quantity") * (1 + C("l_discount") / 5)).alias("predicted"), "l_suppkey",
    )


@add("eval_numeric", f"WITH x AS ({_PAIR}) SELECT name, count(*) AS n, count(*) FILTER (CASE WHEN truth = 0 THEN abs(predicted) <= 0.01 ELSE abs(predicted - truth) <= abs(truth) * 0.01 END) AS close FROM x GROUP BY name")
def _(spark, sf):
    return _pairs(spark, sf).groupBy("name").agg(F.count("*").alias("n"), F.count_if(E.close(C("predicted"), C("truth"))).alias("close"))


_PNAME = "CASE l_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || '!' ELSE 'other ' || p_name END"
_N = "trim(translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''))"


_OTHER = "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || chr(33) WHEN 2 THEN 'other ' || p_name WHEN 3 THEN string_split(p_name, ' ')[2] || ' steel' ELSE 'copper' END"


@add("eval_field_match", f"""WITH x AS (SELECT p_partkey, p_size, {_N.format('p_name')} AS a, {_N.format(_OTHER)} AS b FROM part),
  s AS (SELECT *, CASE WHEN contains(a, b) OR contains(b, a) THEN 1.0 WHEN len(list_intersect(string_split(a, ' '), string_split(b, ' '))) * 2 >= least(len(list_distinct(string_split(a, ' '))), len(list_distinct(string_split(b, ' ')))) THEN 0.5 ELSE 0.0 END AS name_score FROM x)
  SELECT p_partkey, CAST(name_score AS DOUBLE) AS name_score, round(CAST(name_score + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 < 2 THEN 1 ELSE 0 END AS DOUBLE) / 3, 6) AS score FROM s""")
def _(spark, sf):
    """Each part against itself under another name, every second in another category, every third in another unit."""
    k, n = C("p_partkey") % 5, C("p_name")
    name = F.when(k == 0, n).when(k == 1, F.concat(F.upper(n), F.lit("!"))).when(k == 2, F.concat(F.lit("other "), n)).when(k == 3, F.concat(F.split(n, " ")[1], F.lit(" steel"))).otherwise("copper")
    said = {"name": name, "category": F.when(C("p_size") % 2 == 0, F.concat(F.lit(" "), F.upper("p_type"))).otherwise("none"), "unit": F.when(C("p_size") % 3 == 0, "KG").when(C("p_size") % 3 == 1, "kg.").otherwise("g")}
    true = {"name": n, "category": C("p_type"), "unit": F.lit("kg")}
    return V.table(spark, sf, "part").select("p_partkey", E.name_score(name, n).alias("name_score"), F.round(E.field_score(said.get, true.get), 6).alias("score"))


@add("eval_set_recall", f"""WITH x AS ({_PAIR}), f AS (SELECT file, list_distinct(list(name)) AS t, list_distinct(list(name) FILTER (l_suppkey % 2 = 0)) AS p FROM x GROUP BY file) SELECT count(*) AS files, round(avg(len(list_intersect(t, coalesce(p, []))) / len(t)), 6) AS recall FROM f""")
def _(spark, sf):
    f = _pairs(spark, sf).groupBy("file").agg(F.collect_set("name").alias("t"), F.collect_set(F.when(C("l_suppkey") % 2 == 0, C("name"))).alias("p"))
    return f.agg(F.count("*").alias("files"), F.round(F.avg(F.size(F.array_intersect("t", "p")) / F.size("t")), 6).alias("recall"))


@add("eval_grounding", f"WITH x AS ({_PAIR}) SELECT count(*) FILTER (abs(predicted - truth) <= abs(truth) * 0.01) AS right_values, count(*) FILTER (abs(predicted - truth) <= abs(truth) * 0.01 AND place % 4 = l_suppkey % 4) AS grounded FROM x")
def _(spark, sf):
    right = F.abs(C("predicted") - C("truth")) <= F.abs("truth") * 0.01
    return _pairs(spark, sf).agg(F.count_if(right).alias("right_values"), F.count_if(right & (C("place") % 4 == C("l_suppkey") % 4)).alias("grounded"))


@add("eval_valid_json", "SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(CASE WHEN event_id % 5 = 0 THEN substring(props, 2) ELSE props END)) AS valid FROM events GROUP BY event_type")
def _(spark, sf):
    p = F.when(C("event_id") % 5 == 0, F.expr("substring(props, 2)")).otherwise(C("props"))
    return V.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.from_json(p, "map<string,string>").isNotNull()).alias("valid"))


@add("eval_first_match", f"""WITH x AS ({_PAIR}), p AS (SELECT file, lower(name) AS k, arg_min(predicted, place) AS predicted FROM x GROUP BY ALL HAVING count(*) = count(DISTINCT place)), t AS (SELECT DISTINCT file, name FROM x)
  SELECT t.file, t.name, p.k IS NOT NULL AS found FROM t LEFT JOIN p ON p.file = t.file AND p.k = lower(t.name)""")
def _(spark, sf):
    x = _pairs(spark, sf)
    solo = x.groupBy("file", "name").agg(F.count("*").alias("n"), F.countDistinct("place").alias("d"), F.min("place").alias("place"), F.min_by("predicted", "place").alias("value")).where("n = d")
    return E.first_by_name(solo, x.select("file", "name").distinct(), "file", "place").select("file", "name", F.coalesce("found", F.lit(False)).alias("found"))


_RECORDS = """SELECT l_orderkey AS file, l_linenumber AS place, l_partkey, l_suppkey, 'Part ' || (l_partkey % 9) AS flow_name, CASE WHEN l_partkey % 2 = 0 THEN 'Gas' END AS category, 'kg' AS unit, l_quantity AS value, 'c' || (l_suppkey % 4) AS chunk_id FROM lineitem"""


def _records(spark, sf):
    return V.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS file", "(l_linenumber * 100000000 + l_partkey) * 1000000 + l_suppkey AS place", "concat('Part ', l_partkey % 9) AS flow_name", "CASE WHEN l_partkey % 2 = 0 THEN 'Gas' END AS category", "'kg' AS unit",
        "l_quantity AS value", "concat('c', l_suppkey % 4) AS chunk_id",
    )


@add("eval_zip", f"""WITH r AS ({_RECORDS}), t0 AS (SELECT * FROM r WHERE file % 40 <> 1), p0 AS (SELECT file, (place * 100000000 + l_partkey) * 1000000 + l_suppkey AS place, flow_name || '!' AS flow_name, category, unit, CASE WHEN file % 3 = 0 THEN value * 1.05 ELSE value * 1.001 END AS value, chunk_id FROM r WHERE file % 40 <> 3),
tp AS (SELECT file, row_number() OVER (ORDER BY file) AS position FROM (SELECT DISTINCT file FROM t0)), pp AS (SELECT file, row_number() OVER (ORDER BY file) AS position FROM (SELECT DISTINCT file FROM p0)),
t AS (SELECT * FROM t0 JOIN tp USING (file)), p AS (SELECT * FROM p0 JOIN pp USING (file)),
tt AS (SELECT DISTINCT position, unnest(list_filter([lower(flow_name), lower(category), unit], lambda x: x IS NOT NULL)) AS text FROM t), pt AS (SELECT DISTINCT position, unnest(list_filter([replace(lower(flow_name), '!', ''), lower(category), unit], lambda x: x IS NOT NULL)) AS text FROM p),
s AS (SELECT position, count(pt.text) / count(*) AS recall FROM tt LEFT JOIN pt USING (position, text) WHERE position IN (SELECT position FROM pp) GROUP BY position),
f AS (SELECT position, replace(lower(flow_name), '!', '') AS n, arg_min(value, place) AS pv, arg_min(chunk_id, place) AS pc FROM p GROUP BY ALL), j AS (SELECT t.*, pv, pc, abs(pv - value) <= abs(value) * 0.01 AS ok FROM t JOIN f ON f.position = t.position AND f.n = lower(t.flow_name)),
c AS (SELECT count(*) AS numbers, count(*) FILTER (ok) AS right_, count(*) FILTER (ok AND pc = chunk_id) AS grounded FROM j)
SELECT (SELECT count(*) FROM pp) AS files, round((SELECT sum(recall) FROM s) / (SELECT count(*) FROM pp), 6) AS em, numbers, right_ AS "right", round(right_ / numbers, 6) AS num_acc, grounded, round(grounded / right_, 6) AS grounding FROM c""")
def _(spark, sf):
    r = _records(spark, sf)
    off = F.when(C("file") % 3 == 0, C("value") * 1.05).otherwise(C("value") * 1.001)
    return E.zipped(r.where("file % 40 <> 3").withColumns({"flow_name": F.concat("flow_name", F.lit("!")), "value": off}), r.where("file % 40 <> 1"))


# --- calculation -----------------------------------------------------------------------------------------------------
@add("safe_calculate", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, round(l_quantity * l_discount + sqrt(abs(l_tax - 1)), 6) AS result, true AS success FROM lineitem")
def _(spark, sf):
    rows = V.table(spark, sf, "lineitem")
    variables = F.create_map(F.lit("q"), "l_quantity", F.lit("d"), "l_discount", F.lit("t"), "l_tax")
    r = calculate("q * d + sqrt(abs(t - 1))", variables)
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.round(r["result"], 6).alias("result"), r["success"].alias("success"))


@add("safe_calculate_errors", "SELECT p_size % 5 AS kind, p_size % 5 = 0 AS success, count(*) AS n FROM part GROUP BY ALL")
def _(spark, sf):
    texts = ("2 ** 3", "1 / 0", "__import__('os')", "x +", "sqrt(0 - 1)")
    success = F.coalesce(*[F.when(C("p_size") % 5 == i, calculate(e)["success"]) for i, e in enumerate(texts)])
    return V.table(spark, sf, "part").groupBy((C("p_size") % 5).alias("kind"), success.alias("success")).agg(F.count("*").alias("n"))


@add("argument_aliases", """SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN 0.5 END, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) END) AS value, CASE WHEN p_size % 5 = 0 THEN 'kg' END AS unit,
  (p_size % 2 = 0 OR p_size % 3 = 0)::INTEGER + (p_size % 5 = 0)::INTEGER AS given FROM part""")
def _(spark, sf):
    told = F.to_json(F.struct(F.when(C("p_size") % 2 == 0, 0.5).alias("value"), F.when(C("p_size") % 3 == 0, C("p_size").cast("double")).alias("amount"), F.when(C("p_size") % 5 == 0, "kg").alias("unit"), F.lit(None).cast("string").alias("note")))
    rows = V.table(spark, sf, "part").select("p_partkey", H.arguments(told, {"value": ("value", "quantity", "amount", "val"), "unit": ("unit",), "note": ("note",)}).alias("a"))
    return rows.select("p_partkey", C("a")["value"].try_cast("double").alias("value"), C("a")["unit"].alias("unit"), F.size("a").alias("given"))


_CODE = """concat(CASE conv_id % 9 WHEN 0 THEN 'import numpy as np' WHEN 1 THEN 'from json import loads' WHEN 2 THEN 'import Os' WHEN 3 THEN '  import sys' WHEN 4 THEN 'x = EVAL(1)' WHEN 5 THEN 'from pandas.core import frame'
  WHEN 6 THEN 'import math, json' WHEN 7 THEN 'model' ELSE 'x = 1' END, chr(10), 'y = ', turn)"""


@add("code_safety", "SELECT conv_id, turn, conv_id % 9 IN (0, 1, 5, 7, 8) AS safe FROM conversations")
def _(spark, sf):
    return _msgs(spark, sf).select("conv_id", "turn", H.safe_code(F.expr(_CODE)).alias("safe"))


_LEAK = """CASE event_id % 6 WHEN 0 THEN concat('a |', chr(10), '| b') WHEN 1 THEN '{"action_id": 1, "record_type": 2}' WHEN 2 THEN '"session_id" alone' WHEN 3 THEN repeat('"', 50) WHEN 4 THEN repeat('"', 51) ELSE props END"""


@add("json_leak", "SELECT event_id, event_id % 6 IN (0, 1, 4) AS leaked, event_id % 6 IN (0, 1, 4) AS replaced FROM events")
def _(spark, sf):
    text = F.expr(_LEAK)
    return V.table(spark, sf, "events").select("event_id", H.leaks_json(text).alias("leaked"), (H.without_leaks(text) != text).alias("replaced"))
