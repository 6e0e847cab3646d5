"""Chat logs: parsing, history, repair, export to training samples, and validation."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turns():
    return Window.partitionBy("conv_id").orderBy("turn")


def conversation():
    return Window.partitionBy("conv_id")


def history(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each conversation (all, if n <= 0) but system ones."""
    if n > 0:
        back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
        messages = messages.withColumn("__b", F.row_number().over(back)).where(F.col("__b") <= n).drop("__b")
    return messages.where("role <> 'system'")


def history_text(messages: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` messages of each conversation, a line each, 200 characters of each."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("__b", F.row_number().over(back)).where(F.col("__b") <= n)
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.upper("role"), F.lit(": "), F.substring("text", 1, 200)).alias("l"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda r: r["l"]), "\n").alias("history"))


def context(messages: DataFrame, n: int = 15) -> DataFrame:
    """The first system message and the last ``n`` others."""
    system = F.col("role") == "system"
    w, back = Window.partitionBy("conv_id", system).orderBy("turn"), Window.partitionBy("conv_id", system).orderBy(F.desc("turn"))
    rows = messages.withColumn("__f", F.row_number().over(w)).withColumn("__b", F.row_number().over(back))
    return rows.where((system & (F.col("__f") == 1)) | (~system & (F.col("__b") <= n))).drop("__f", "__b")


def merge_runs(messages: DataFrame) -> DataFrame:
    """Adjacent messages of one role as one, joined by line feeds."""
    change = F.coalesce((F.col("role") != F.lag("role").over(turns())).cast("int"), F.lit(1))
    rows = messages.withColumn("__change", change).withColumn("run", F.sum("__change").over(turns()))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n")
    return rows.groupBy("conv_id", "run", "role").agg(text.alias("text"), F.min("turn").alias("turn"), F.count("*").alias("n"))


def user_first(messages: DataFrame) -> DataFrame:
    """Text of assistant turns before the first user turn goes in front of that turn; those turns go."""
    rows = messages.where("role <> 'system'").withColumn("first", F.min(F.when(F.col("role") == "user", F.col("turn"))).over(conversation()))
    early = F.col("turn") < F.col("first")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n")
    leads = rows.where(early).groupBy(F.col("conv_id").alias("__c"), F.col("first").alias("__f")).agg(text.alias("lead"))
    rest = rows.where(~early | F.col("first").isNull()).join(leads, (F.col("conv_id") == F.col("__c")) & (F.col("turn") == F.col("__f")), "left")
    return rest.select("conv_id", "turn", "role", F.concat_ws("\n", F.nullif("lead", F.lit("")), "text").alias("text"))


def drop_leading(messages: DataFrame) -> DataFrame:
    """Without system turns and assistant turns before the first user or tool turn."""
    first = F.min(F.when(F.col("role").isin("user", "tool"), F.col("turn"))).over(conversation())
    return messages.withColumn("__f", first).where((F.col("role") != "system") & (F.col("turn") >= F.col("__f"))).drop("__f")


def session_tag(text: Column) -> Column:
    """The session that a message's tag names; empty without a tag."""
    return F.regexp_extract(text, r"^\[PDF_SESSION_ID:([^\]]*)\]", 1)


def sse(event: Column, data: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def sse_parts(sent: Column) -> Column:
    """struct(event, data) of a server-sent event with one line of data."""
    lines = F.split(sent, "\n")
    return F.struct(F.regexp_replace(F.get(lines, F.lit(0)), "^event: ", "").alias("event"), F.regexp_replace(F.get(lines, F.lit(1)), "^data: ", "").alias("data"))


def parse_response(text: Column) -> Column:
    """struct(think, tool_names, content) of a tagged reply."""
    calls = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    names = F.filter(F.transform(calls, lambda c: F.get_json_object(c, "$.name")), lambda n: n.isNotNull())
    content = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<tool_call>.*?</tool_call>", "")
    return F.struct(F.trim(F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)).alias("think"), names.alias("tool_names"), F.trim(content).alias("content"))


def tool_calls(text: Column, n: int = 10) -> Column:
    """The first ``n`` distinct tool calls by name and arguments in canonical form."""
    calls = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(calls, lambda c: F.concat_ws(" ", F.get_json_object(c, "$.name"), F.get_json_object(c, "$.arguments")))), 1, n)


# What replies say where nothing is left of them.
COMPLETED = "I have completed the requested operations. The data has been recorded successfully. Please check the session summary for details."
SEARCHED = (
    "✅ I have completed searching and recording data from the document.\n\nThe extracted information has been recorded in the database. "
    "Please check the session summary for detailed action IDs and values."
)
ANALYZED = "I've analyzed your request. Please let me know if you need more details."
PROCESSED = "I've processed your request. The data has been recorded successfully."
_RESPONSES = r"(?s)<tool_response>.*?</tool_response>"


def cleaned(text: Column) -> Column:
    """struct(thinking, reply) of a raw reply, without tool responses, which a model should not write, and their stray tags.

    A reply under 50 characters without thinking or tool calls is replaced. ``thinking`` is the first one's text; the
    reply has none, and no stray ends.
    """
    cut = lambda c, *patterns: cut(F.trim(F.regexp_replace(c, patterns[0], "")), *patterns[1:]) if patterns else c
    bare = cut(text, r"(?s)^[^<]*</tool_response>", _RESPONSES, "</?tool_response>")
    short = (F.length(bare) < 50) & ~F.contains(bare, F.lit("<think>")) & ~F.contains(bare, F.lit("<tool_call>"))
    kept = F.when(short, F.lit(COMPLETED)).otherwise(bare)
    reply = F.when(F.rlike(kept, F.lit("(?s)<think>.*?</think>")), cut(kept, "(?s)<think>.*?</think>", "(?i)</think>", _RESPONSES)).otherwise(kept)
    return F.struct(F.trim(F.regexp_extract(kept, "(?s)<think>(.*?)</think>", 1)).alias("thinking"), reply.alias("reply"))


def with_fallback(text: Column, results: Column) -> Column:
    """struct(thinking, content) of a reply, with what to say where it holds tool calls or thinking alone.

    ``results``: array of struct(tool_name, result). Thinking that is not closed ends the reply. Recorded tools are those
    whose result says success or recorded, each once, in the order of the alphabet.
    """
    closed, opened = F.contains(text, F.lit("</think>")), F.contains(text, F.lit("<think>"))
    thinking = F.trim(F.when(closed, F.regexp_extract(text, "(?s)<think>(.*?)</think>", 1)).when(opened, F.regexp_extract(text, "(?s)<think>(.*)$", 1)).otherwise(""))
    content = F.when(closed, F.regexp_replace(text, "(?s)<think>.*?</think>", "")).when(opened, F.substring_index(text, "<think>", 1)).otherwise(text)
    for pattern in (r"</?tool_call>?", r"<\|/?tool_call\|>?", r'\{"name":\s*"[^"]*"[^}]*\}?'):
        content = F.regexp_replace(content, pattern, "")
    content = F.trim(content)
    done = F.filter(results, lambda r: F.rlike(F.lower(r["result"]), F.lit("success|recorded")))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(done, lambda r: r["tool_name"]))), ", ")
    said = F.concat(
        F.lit("I've successfully recorded the data using "), F.size(results).cast("string"), F.lit(" tool calls. The recorded items include: "), names,
        F.lit(". Let me know if you need more details or want to extract additional data."),
    )
    fallback = F.when(F.size(results) > 0, F.when(F.size(done) > 0, said).otherwise(PROCESSED)).when(thinking != "", ANALYZED).otherwise("")
    return F.struct(thinking.alias("thinking"), F.when(content == "", fallback).otherwise(content).alias("content"))


def leaks_json(content: Column) -> Column:
    """Whether a final reply shows raw table rows or JSON: a row break, two of the log's keys together, or over 50 quotes."""
    has = lambda *words: reduce(and_, [F.contains(content, F.lit(w)) for w in words])
    quotes = F.length(content) - F.length(F.replace(content, F.lit('"'), F.lit("")))
    return has("|\n|") | has("|\\n|") | has('"action_id"', '"record_type"') | has('"session_id"', '"timestamp"') | (quotes > 50)


def without_leaks(content: Column) -> Column:
    return F.when(leaks_json(content), F.lit(SEARCHED)).otherwise(content)


# What code may not hold, and the modules it may import.
DANGEROUS = (
    "import os", "import subprocess", "import shutil", "import socket", "import urllib", "import requests", "open(", "file(", "exec(", "eval(", "__import__", "globals()",
    "locals()", "rm ", "del ", "rmdir", "unlink",
)
ALLOWED_IMPORTS = ("olca", "uuid", "decimal", "json", "math", "datetime", "numpy", "pandas", "brightway2", "bw2data", "bw2calc")


def safe_code(code: Column) -> Column:
    """Whether code holds nothing dangerous in any case and imports allowed modules alone. Null is not safe."""
    banned = F.exists(F.array(*[F.lit(w) for w in DANGEROUS]), lambda w: F.contains(F.lower(code), w))
    imports = F.filter(F.transform(F.split(code, "\n"), lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit("^(?:import|from) ")))
    modules = F.transform(imports, lambda x: F.regexp_extract(x, r"^(?:import|from)\s+([^\s.]*)", 1))
    return F.coalesce(~banned & F.forall(modules, lambda m: m.isin(*ALLOWED_IMPORTS)), F.lit(False))


def prompt(messages: DataFrame) -> DataFrame:
    """The log as one text with role markers."""
    piece = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>"))
    rows = F.array_sort(F.collect_list(F.struct("turn", piece.alias("p"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda s: s["p"]), "\n").alias("prompt"), F.count("*").alias("n"))


def tokens(text: Column) -> Column:
    """An estimate: a quarter of the characters, rounded up, at least 1; 0 for no text."""
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), F.ceil(F.length(text) / 4))).otherwise(0).cast("long")


# Phrases of reasoning that found nothing, tools that record, and the mark of a place to be filled.
NOT_FOUND = ("couldn't find", "not found", "no data", "没找到", "未找到")
RECORDING = ("record_process_flow", "record_parameter", "define_lca_scope")
PLACEHOLDER = "[SMART_SKIP_PLACEHOLDER"


def validate(samples: DataFrame) -> DataFrame:
    """(sample, place, call, issue): one row for each broken rule of each message or, with ``call`` set, tool call.

    Messages have role, content, reasoning and tool_calls, a JSON list (null: none). Null and empty texts are missing;
    the first message may be an empty one of the user.
    """
    role, empty = F.col("role"), lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    rows = samples.withColumn("__calls", F.coalesce(F.from_json("tool_calls", "array<string>"), F.array().cast("array<string>")))
    called, first = F.size("__calls") > 0, F.get_json_object(F.get("__calls", F.lit(0)), "$.name")
    nothing = F.exists(F.array(*[F.lit(p) for p in NOT_FOUND]), lambda p: F.contains(F.lower("reasoning"), p))
    rules = {
        "missing_reasoning": (role == "assistant") & called & empty("reasoning"), "missing_content": (role == "assistant") & ~called & empty("content"),
        "reasoning_action_mismatch": (role == "assistant") & called & nothing & first.isin(*RECORDING),
        "placeholder_not_replaced": (role == "assistant") & F.contains("reasoning", F.lit(PLACEHOLDER)),
        "empty_tool_calls": (role == "assistant") & F.col("tool_calls").isNotNull() & ~called, "empty_tool_response": (role == "tool") & empty("content"),
        "empty_user_content": (role == "user") & empty("content") & (F.col("place") > 0),
    }

    def faults(call: Column, i: Column) -> Column:
        arguments = F.get_json_object(call, "$.arguments")
        wrong = F.when(~F.startswith(F.trim(call), F.lit("{")), F.array(F.lit("invalid_tool_call"))).otherwise(F.array_compact(F.array(
            F.when(F.get_json_object(call, "$.name").isNull(), "missing_tool_name"),
            F.when(arguments.isNull(), "missing_tool_args").when(~F.startswith(arguments, F.lit("{")), "invalid_tool_args"),
        )))
        return F.transform(wrong, lambda w: F.struct(i.alias("call"), w.alias("issue")))

    of_message = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(None).cast("int").alias("call"), F.lit(name).alias("issue"))) for name, rule in rules.items()]))
    of_calls = F.when(role == "assistant", F.flatten(F.transform("__calls", faults))).otherwise(F.array().cast("array<struct<call:int,issue:string>>"))
    return rows.select("sample", "place", F.inline(F.concat(of_message, of_calls)))


def validate_files(files: DataFrame) -> DataFrame:
    """(file, issue) of files (file, content) that are no JSON, or neither a list nor an object with messages.

    Parsers stop where a first value ends; that nothing follows is seen by the content as the only item of a list.
    """
    alone = F.json_array_length(F.concat(F.lit("["), F.col("content"), F.lit("]"))) == 1
    parsed = F.when(F.coalesce(alone, F.lit(False)), F.try_parse_json("content"))
    shaped = F.startswith(F.ltrim("content"), F.lit("[")) | F.try_variant_get(parsed, "$.messages", "variant").isNotNull()
    issue = F.when(parsed.isNull(), "json_error").when(~shaped, "format_error")
    return files.select("file", issue.alias("issue")).where("issue IS NOT NULL")


def validation_report(files: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """One row: files, files with issues, and the rate of those without, in per cent to one digit."""
    bad = issues.select(F.col(key).alias("__k")).distinct()
    rows = files.select(key).distinct().join(bad, F.col(key) == F.col("__k"), "left")
    n, wrong = F.count("*"), F.count("__k")
    return rows.agg(n.alias("files"), wrong.alias("files_with_issues"), F.round(100 * (1 - wrong / F.greatest(n, F.lit(1))), 1).alias("pass_rate"))


#: How many samples of each kind are for evaluation.
EVAL_SAMPLES = {"FULL": 3, "SHORT_E": 4, "SHORT_QA": 5}


def split_sample(rows: DataFrame, by: str, order: Column, sizes: dict[str, int] = EVAL_SAMPLES) -> DataFrame:
    """Adds ``part``: eval for the first rows of each kind in ``order``, as many as ``sizes`` says, else train."""
    n = F.try_element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col(by))
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("part", F.when(place <= F.coalesce(n, F.lit(0)), "eval").otherwise("train"))


def arguments(told: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """Arguments of a tool call (JSON) by their own names: of an argument's aliases the first that is given; nulls go."""
    given = [F.struct(F.lit(name).alias("key"), F.coalesce(*[F.get_json_object(told, f"$.{a}") for a in others]).alias("value")) for name, others in aliases.items()]
    return F.map_from_entries(F.filter(F.array(*given), lambda e: e["value"].isNotNull()))


def changes(messages: DataFrame) -> DataFrame:
    """Rows whose text differs from the one before in their conversation."""
    return messages.withColumn("__l", F.lag("text").over(turns())).where(~F.col("text").eqNullSafe(F.col("__l"))).drop("__l")


def deltas(snapshots: DataFrame) -> DataFrame:
    """What each growing snapshot adds to the one before; the whole text where it does not continue it."""
    before = F.coalesce(F.lag("text").over(turns()), F.lit(""))
    rows = snapshots.withColumn("__l", before)
    return rows.withColumn("delta", F.when(F.startswith("text", "__l"), F.expr("substring(text, length(__l) + 1)")).otherwise(F.col("text"))).drop("__l")


def pieces(text: Column, size: int = 50) -> Column:
    """The text in pieces of ``size`` characters."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1)), F.array().cast("array<string>"))  # one pass over the text
