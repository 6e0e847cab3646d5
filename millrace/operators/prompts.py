"""Texts that a model is shown: catalog flows, contexts, tool responses, actions and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _or(c: Column, other: str) -> Column:
    return F.coalesce(c.cast("string"), F.lit(other))


def _get(json: Column, path: str, other: str = "None") -> Column:
    return _or(F.get_json_object(json, path), other)


def shortened(text: Column, n: int) -> Column:
    """The first ``n`` characters, with dots where there are more."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("...")))


def flow_text(name: Column, categories: Column, description: Column) -> Column:
    """What a catalog flow's vector is made from."""
    return F.concat_ws(" ", name, categories, F.substring(description, 1, 200))


def labelled(**parts: Column) -> Column:
    """``Name: value`` of the parts that are not empty, joined by bars."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{k}: "), F.nullif(v, F.lit(""))) for k, v in parts.items()])


def preview(source: Column, text: Column, n: int = 500) -> Column:
    return F.concat(F.lit("Document: "), source, F.lit("\n"), shortened(text, n))


def rewritten(reply: Column, name: Column, most: int = 100) -> Column:
    """The name in a model's rewriting of ``name``: what follows its last thinking, without quotes around it.

    Where that is empty or no shorter than ``most`` characters, or there is no reply, the old name stays.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    thought = F.contains(reply, F.lit("<think>")) & F.contains(reply, F.lit("</think>"))
    bare = strip(F.regexp_replace(strip(F.when(thought, F.substring_index(reply, "</think>", -1)).otherwise(reply)), "^[\"']+|[\"']+$", ""))
    return F.when((F.length(bare) > 0) & (F.length(bare) < most), bare).otherwise(name)


# What a material's name and note say it is; the first that holds counts.
MATERIAL_HINTS = (
    (("316l",), "316L stainless steel"), (("stainless steel",), "stainless steel"), (("x2crni",), "stainless steel"), (("steel", "powder"), "steel powder"), (("titanium",), "titanium alloy"),
    (("ti6al4v",), "titanium alloy"), (("ti-6al-4v",), "titanium alloy"), (("aluminum",), "aluminum"), (("aluminium",), "aluminum"),
)
MATERIAL_CATEGORIES = ("Raw Material", "Process Material")


def material_hint(name: Column, note: Column) -> Column:
    """What a material is, by its name and note; null where neither says."""
    text = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(note, F.lit(""))))
    out = None
    for words, hint in MATERIAL_HINTS:
        held = F.contains(text, F.lit(words[0]))
        for w in words[1:]:
            held = held & F.contains(text, F.lit(w))
        out = F.when(held, hint) if out is None else out.when(held, hint)
    return out


def material_hints(flows: DataFrame) -> DataFrame:
    """(session_id, hints): the distinct hints of a session's materials, in the alphabet's order. ``flows``: session_id, category, name, note."""
    rows = flows.where(F.col("category").isin(*MATERIAL_CATEGORIES))
    return rows.groupBy("session_id").agg(F.array_sort(F.collect_set(material_hint(F.col("name"), F.col("note")))).alias("hints"))


# What the prompt of a document says.
LEGEND = ("- [DIRECT] = state the final value directly", "- [CALCULABLE] = flow calculated from parameters", "- [CONTEXT] = additional process parameters for context")
TIPS = {
    "complex": "\n\n**For Complex documents**: Present the underlying parameters for [CALCULABLE] flows rather than the final calculated value, and describe key relationships in concise prose rather than long algebraic derivations.",
    "medium": "\n\n**Tip for Medium documents**:\n- You may briefly mention in words how some totals or ratios are obtained from underlying values, but avoid extended step-by-step calculations.",
}
GUIDANCE = (
    "\n\n**Integration guidance**:\n- Do not simply copy the 'Data to document' list into the report as a single block.\n- Integrate these values into the sections where they naturally belong "
    "(for example material balance, energy analysis, gas consumption, results, or KPI tables).\n- It is acceptable if some contextual parameters are only mentioned once in a focused section, "
    "rather than being repeated many times across the document."
)
CLOSING = (
    "using tables and narrative paragraphs. Start with a clear document title using # heading. Use proper Markdown formatting (headings, bold text, tables, horizontal rules). Return only the Markdown document.\n"
)


def document_lines(flows: DataFrame, parameters: DataFrame, relations: DataFrame, difficulty: str) -> DataFrame:
    """(session_id, part, seq, k, line): what a document is to tell, inputs, outputs, then parameters.

    ``flows`` (session_id, seq, side: Input or Output, category, name, value, unit, quantity, child_nodes: array of
    struct(name, value, unit)); ``parameters`` (session_id, seq, name, value, unit); ``relations`` (session_id, seq, flow:
    ``category: name``, calculation, parameters_used). Of a flow's relations the last counts. A flow with one is
    calculable, and a complex document tells how; one with child nodes is calculable from them; others are stated.
    """
    last = relations.groupBy(F.col("session_id").alias("__s"), F.col("flow").alias("__f")).agg(F.max_by(F.struct("calculation", "parameters_used"), "seq").alias("__r"))
    key = F.concat("category", F.lit(": "), "name")
    rows = flows.join(last, (F.col("session_id") == F.col("__s")) & (key == F.col("__f")), "left")
    amount = F.concat(F.lit(": "), "value", F.lit(" "), "unit")
    many = F.when((F.col("side") == "Output") & F.col("quantity").isNotNull(), F.concat(F.lit(", "), F.col("quantity").cast("string"), F.lit(" units"))).otherwise("")
    named = F.concat("name", F.lit(" ("), "category", F.lit(")"))
    nodes = F.array_join(F.transform("child_nodes", lambda c: F.concat(c["name"], F.lit(": "), c["value"], F.lit(" "), c["unit"])), ", ")
    told = F.array(F.concat(F.lit("[CALCULABLE] "), named, amount, many))
    if difficulty == "complex":
        used = F.array_join(F.coalesce("__r.parameters_used", F.array().cast("array<string>")), ", ")
        told = F.concat(told, F.array(F.concat(F.lit("  → Calculation: "), F.coalesce("__r.calculation", F.lit(""))), F.concat(F.lit("  → Uses parameters: "), used)))
    grown = F.concat(F.lit("[CALCULABLE] "), named, F.lit(": parameters are "), nodes, F.lit(", final value is "), "value", F.lit(" "), "unit", many)
    lines = F.when(F.col("__r").isNotNull(), told).when(F.size("child_nodes") > 0, F.array(grown)).otherwise(F.array(F.concat(F.lit("[DIRECT] "), named, amount, many)))
    rows = rows.select("session_id", F.when(F.col("side") == "Input", 0).otherwise(1).alias("part"), "seq", F.posexplode(lines).alias("k", "line"))
    context = F.concat(F.lit("[CONTEXT] "), "name", F.lit(": "), "value", F.lit(" "), "unit").alias("line")
    return rows.unionByName(parameters.select("session_id", F.lit(2).alias("part"), "seq", F.lit(0).alias("k"), context))


def document_prompts(names: DataFrame, flows: DataFrame, parameters: DataFrame, relations: DataFrame, difficulty: str, document_type: str) -> DataFrame:
    """(session_id, prompt) of each process of ``names`` (session_id, process_name; null: AM Process). Lines as by :func:`document_lines`."""
    lines = document_lines(flows, parameters, relations, difficulty)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "k", "line"))), lambda r: F.concat(F.lit("- "), r["line"])), "\n")
    lines = lines.groupBy(F.col("session_id").alias("__s")).agg(text.alias("__lines"))
    related = relations.select(F.col("session_id").alias("__t")).distinct()
    rows = names.join(lines, F.col("session_id") == F.col("__s"), "left").join(related, F.col("session_id") == F.col("__t"), "left")
    tip = F.when(F.col("__t").isNotNull(), F.lit(TIPS.get(difficulty, ""))).otherwise("")
    prompt = F.concat(
        F.lit("Process: "), F.coalesce("process_name", F.lit("AM Process")), F.lit("\n\nData to document:\n"), F.coalesce("__lines", F.lit("")), F.lit("\n\nNote: \n" + "\n".join(LEGEND)), tip,
        F.lit(GUIDANCE + f"\n\nWrite a formal {document_type.replace('_', ' ')} " + CLOSING),
    )
    return rows.select("session_id", prompt.alias("prompt"))


def context_summary(contents: Column) -> Column:
    """The first three pieces of a context, 200 characters of each."""
    parts = F.transform(F.slice(contents, 1, 3), lambda c, i: F.concat(F.lit("Section "), (i + 1).cast("string"), F.lit(": "), F.substring(_or(c, ""), 1, 200), F.lit("...")))
    return F.when(F.size(contents) > 0, F.array_join(parts, "\n")).otherwise("No PDF context information available")


def lci_summary(flows: Column) -> Column:
    """One line for each flow: array of struct(name, uuid, unit, location)."""
    line = lambda f: F.concat(F.lit("- "), _or(f["name"], ""), F.lit(", UUID: "), _or(f["uuid"], ""), F.lit(", Unit: "), _or(f["unit"], ""), F.lit(", Location: "), _or(f["location"], ""))
    return F.when(F.size(flows) > 0, F.array_join(F.transform(flows, line), "\n")).otherwise("No available LCI flow data")


def response_summary(tool: Column, content: Column) -> Column:
    """A tool's JSON response in short, with all chunks that were found; of anything else the first 500 characters."""
    found = F.from_json(content, "results array<struct<chunk_id:string,content:string>>")["results"]
    lines = F.array_join(F.transform(found, lambda r: F.concat(F.lit("  - Chunk "), _or(r["chunk_id"], "?"), F.lit(": "), _or(r["content"], ""))), "\n")
    searched = F.when(F.size(found) > 0, F.concat(F.lit("Found "), F.size(found).cast("string"), F.lit(" chunks:\n"), lines)).otherwise("No results found")
    action = F.concat(F.lit(", action_id: "), _get(content, "$.data.action_id", "unknown"))
    told = (
        F.when(tool == "search_document", searched).when(tool == "process_document", F.concat(F.lit("Document processed successfully, session: "), _get(content, "$.session_id", "unknown")))
        .when(tool == "record_process_flow", F.concat(F.lit("Flow recorded successfully"), action))
        .when(tool == "define_lca_scope", F.concat(F.lit("Scope defined: "), _get(content, "$.data.parameter_name", "unknown"), action))
        .when(tool == "get_session_summary", F.concat(F.lit("Completeness: "), _get(content, "$.completeness_score", "0"), F.lit("%, Missing: "), _get(content, "$.missing_categories", "[]")))
    )
    return F.coalesce(F.when(F.try_parse_json(content).isNotNull(), told), F.substring(content, 1, 500))


def next_action(call: Column) -> Column:
    """What a tool call (JSON: name, arguments) does, in words."""
    a = lambda name, other="None": _get(call, f"$.arguments.{name}", other)
    queries = F.array_join(F.coalesce(F.from_json(F.get_json_object(call, "$.arguments.queries"), "array<string>"), F.array().cast("array<string>")), ", ")
    said = {
        "search_document": ("Search the document for: ", queries),
        "record_process_flow": ("Record ", a("flow_type", ""), " flow - ", a("category"), ": ", a("name"), " (", a("value"), " ", a("unit"), ")"),
        "define_lca_scope": ("Define LCA scope parameter: ", a("parameter_name"), " (", a("description", ""), ")"),
        "get_session_summary": ("Check the session summary to assess extraction progress",),
        "record_parameter": ("Record parameter: ", a("parameter_name"), " = ", a("value"), " ", a("unit", "")),
        "execute_calculation": ("Execute calculation: ", a("formula", "")),
    }
    name = F.get_json_object(call, "$.name")
    tree = None
    for tool, parts in said.items():
        text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        tree = F.when(name == tool, text) if tree is None else tree.when(name == tool, text)
    return tree.otherwise(F.concat(F.lit("Call tool: "), _or(name, "None")))


def conversation_history(messages: DataFrame) -> DataFrame:
    """conv_id and history: what an agent sees of its messages (turn, role, name, content, reasoning, tool_calls: JSON list)."""
    reasoning = F.trim(F.regexp_replace(_or(F.col("reasoning"), ""), r"\[SMART_SKIP_PLACEHOLDER:.*?\]", ""))
    calls = F.coalesce(F.from_json("tool_calls", "array<string>"), F.array().cast("array<string>"))
    user = F.when((F.col("role") == "user") & (F.col("content") != ""), F.array(F.concat(F.lit("**User**: "), shortened(F.col("content"), 200))))
    tool = F.when(F.col("role") == "tool", F.array(F.concat(F.lit("**Tool Response ("), _or(F.col("name"), "unknown"), F.lit(")**:\n"), response_summary(_or(F.col("name"), "unknown"), _or(F.col("content"), "")))))
    thought = F.when(reasoning != "", F.array(F.concat(F.lit("**Your Previous Reasoning**: "), reasoning))).otherwise(F.array().cast("array<string>"))
    acted = F.transform(calls, lambda c: F.concat(F.lit("**Your Previous Action**: "), next_action(c)))
    lines = F.coalesce(user, tool, F.when(F.col("role") == "assistant", F.concat(thought, acted)), F.array().cast("array<string>"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", lines.alias("lines"))))
    text = F.array_join(F.flatten(F.transform(ordered, lambda t: t["lines"])), "\n\n")
    return messages.groupBy("conv_id").agg(F.when(text == "", "(No previous actions)").otherwise(text).alias("history"))
