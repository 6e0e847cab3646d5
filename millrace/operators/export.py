"""Training samples from the action log: messages with tool calls, their responses and reasoning, and question-answer forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import Dealt, borders, carried

# What the exported messages say.
CATEGORY_QUERIES = {
    "Raw Material": "powder material feedstock", "Process Energy": "energy electricity power consumption", "Post-processing Energy": "heat treatment machining post-processing energy",
    "Feedstock Energy": "powder production atomization feedstock energy", "Gas": "gas argon nitrogen shielding", "Cooling Media": "water cooling liquid coolant",
    "Product": "product part manufactured output", "Recovered Material": "recovered reuse recycled powder", "Waste": "waste scrap trimmings dust disposal",
    "Emission": "emissions CO2 exhaust gas", "Energy": "energy electricity power consumption", "Ancillary Material": "gas argon nitrogen auxiliary", "Water": "water cooling liquid",
    "By-product": "recovered reuse recycled powder", "Emissions": "emissions CO2 exhaust gas", "Wastewater": "wastewater effluent discharge", "Transport Service": "transport shipping logistics",
}
SUMMARIES = ("summary", "summary_check")
RECORDS = ("parameter", "flow", "calculation", "scope")
DOCUMENT = '\n\n**DOCUMENT CONTEXT**: \nA PDF document has been uploaded and is ready for analysis.\n- Document Name: "{0}"\n- Document ID: {1}...\n'
PREVIEWS = ('\n**CHUNK 0 PREVIEW** (Executive Summary / Introduction):\n"{0}"\n', '\n**CHUNK 1 PREVIEW**:\n"{0}"\n')
INJECTION = (
    "\n**AUTOMATIC SESSION INJECTION**: \nWhen you call document-related tools (search_document, record_parameter, record_calculation, record_process_flow, get_session_summary, define_lca_scope, "
    "record_pivot_failure), the system will AUTOMATICALLY inject the session_id for you.\n\nYou do NOT need to ask the user for session_id. "
    'Just call the tools directly with other required parameters (e.g., "query" for search_document).'
)
QA_INJECTION = (
    "\n**AUTOMATIC SESSION INJECTION**: \nWhen you call search_document, the system will AUTOMATICALLY inject the session_id for you.\n\n"
    "You do NOT need to ask the user for session_id. Just call the tool directly with the query parameter."
)
_CHUNKS = "array<struct<chunk_id:string,content:string>>"
#: Fixed value: sessions of so many actions end with a reply though they end without a summary.
SHORT_SESSION = 5


# --- JSON as text ----------------------------------------------------------------------------------------------------
def json_of(c: Column) -> Column:
    """A scalar as JSON; null as null. It is written once: a text's own brackets stand inside of its quotes."""
    return F.btrim(F.to_json(F.array(c)), F.lit("[]"))


def compact(fields: dict[str, Column]) -> Column:
    """A JSON object of values, nulls as well."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})


def longer(fields: dict[str, Column], last: str, parts: dict[str, Column], optional: dict[str, Column]) -> Column:
    """The same with an object ``last`` of ``parts``, and after it ``optional`` JSON texts, left out where they are null.

    No part is an object, so that the braces at the end are those of the two objects.
    """
    inner = F.struct(*(v.alias(k) for k, v in parts.items()))
    more = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in optional.items()]
    return F.concat(F.concat_ws(",", F.concat(F.rtrim(compact(fields | {last: inner}), F.lit("}")), F.lit("}")), *more), F.lit("}"))


def indented(fields: dict[str, Column], depth: int = 1) -> Column:
    """The same over several lines, two blanks for each level; null fields are left out."""
    pieces = [F.concat(F.lit("  " * depth + f'"{k}": '), v) for k, v in fields.items()]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *pieces), F.lit("\n" + "  " * (depth - 1) + "}"))


def _listed(items: Column, shown) -> Column:
    """An array as an indented list of JSON texts, one level deep; ``shown`` makes an item's text, once."""
    return F.when(F.size(items) > 0, F.concat(F.lit("[\n    "), F.array_join(F.transform(items, shown), ",\n    "), F.lit("\n  ]"))).otherwise("[]")


def response(fields: dict[str, Column]) -> Column:
    return F.concat(F.lit("<tool_response>\n"), indented(fields), F.lit("\n</tool_response>"))


# --- tool calls and their responses ----------------------------------------------------------------------------------
def category_query(category: Column) -> Column:
    """What to search for to find a category's flows; null for a category that is not known."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CATEGORY_QUERIES.items() for x in pair]), category)


def search_arguments(session_id: Column, queries: Column) -> Column:
    """Arguments of a search as JSON: ``query`` for one, ``queries`` for several."""
    own = {"session_id": session_id}
    return F.when(F.size(queries) > 1, compact(own | {"queries": queries})).otherwise(compact(own | {"query": F.get(queries, F.lit(0))}))


def search_response(queries: Column, found: Column) -> Column:
    """What a search answers: chunks (chunk_id, content) that were found."""
    found, many = F.coalesce(found, F.array().cast(_CHUNKS)), F.size(queries) > 1
    results = _listed(found, lambda c: indented({"chunk_id": json_of(c["chunk_id"]), "content": json_of(c["content"])}, 3))
    said = F.concat(F.lit('"Found '), F.size(found).cast("string"), F.lit(' relevant results"'))
    return response({"success": F.lit("true"), "message": said, "results": results, "queries": F.when(many, _listed(queries, json_of)), "query": F.when(~many, json_of(F.get(queries, F.lit(0))))})


def call(name: str, arguments: Column) -> Column:
    """A tool call as JSON."""
    return F.concat(F.lit(f'{{"name":"{name}","arguments":'), arguments, F.lit("}"))


def record_call(known) -> Column:
    """The call that made a record, by its type; null for types that no tool makes.

    ``known``: a function that gives a column of the action by name.
    """
    said = lambda *names: {n: F.when(F.length(known(n)) > 0, json_of(known(n))) for n in names}
    take = lambda *names: {n: known(n) for n in ("session_id", *names)}
    chunk, r = {n: known("selected_chunk")[n] for n in ("chunk_id", "content")}, known("record_type")
    chosen = lambda fields, *more: longer(fields, "selected_chunk", chunk, said("note", *more))
    needs = F.coalesce(known("data_dependencies"), F.array().cast("array<string>"))
    return (
        F.when(r == "parameter", call("record_parameter", chosen(take("parameter_name", "parameter_value", "parameter_unit"))))
        .when(r == "flow", call("record_process_flow", chosen(take("flow_type", "category", "name", "value", "unit"), "process_name", "cas_number", "location")))
        .when(r == "calculation", call("execute_calculation", compact(take() | {"expression": known("calculation_expression"), "dependencies": needs})))
        .when(r == "scope", call("define_lca_scope", chosen(take("parameter_name", "description", "value", "unit", "source_content"))))
        .when(_is_summary(known), call("get_session_summary", compact(take() | {"format": F.lit("text")})))
    )


def _is_summary(known) -> Column:
    return known("record_type").isin(*SUMMARIES) | F.coalesce(known("intent") == "get_summary", F.lit(False))


def record_response(known, summary: Column) -> Column:
    """What the call answers. ``summary``: the session's summary text, for calls that ask for it."""
    j = lambda name: json_of(known(name))
    words = lambda *parts: json_of(F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("None")) for p in parts]))
    done, r = {"success": F.lit("true")}, known("record_type")
    own = {"record_id": words(known("session_id"), "/", known("action_id")), "action_id": j("action_id"), "session_id": j("session_id")}
    flow = own | {n: j(n) for n in ("flow_type", "category")} | {"name": json_of(F.coalesce(known("name"), F.lit("")))} | {n: j(n) for n in ("value", "unit")}
    name, parameter = F.coalesce(known("name"), F.lit("")), F.coalesce(known("parameter_name"), F.lit(""))
    return (
        F.when(r == "parameter", response(done | {"message": words("Parameter recorded with action_id: ", known("action_id")), "new_action_id": j("action_id")}))
        .when(r == "flow", response(done | {"message": words("Successfully recorded process flow: ", name), "data": indented(flow, 2)}))
        .when(r == "calculation", response(done | {"message": F.lit('"Calculation executed successfully"'), "result": j("calculation_result"), "unit": j("calculation_unit")}))
        .when(r == "scope", response(done | {"message": words("Successfully defined LCA scope: ", parameter), "data": indented(own | {"parameter_name": json_of(parameter)}, 2)}))
        .when(_is_summary(known), response(done | {"summary": json_of(summary)}))
    )


def earlier_summaries(actions: DataFrame, parts: int | None = None, asks: Column | None = None, begun: DataFrame | bool | None = True) -> DataFrame:
    """(session_id, seq, summary) for each action that asks for a summary: of what its session had recorded before it.

    Calculations are not told. Lines between two such actions are put together once; an action meets these pieces, not
    its session's records. ``asks``: which actions count as asking, those that ask for a summary if not given. Actions without
    a session have nothing before them and are left out. ``begun``: as in :class:`millrace.operators.ordered.Dealt`.
    """
    text = lambda name, other="None": F.coalesce(F.col(name).cast("string"), F.lit(other))
    lines = {
        "scope": F.concat(F.lit("  - "), text("parameter_name", "Unknown"), F.lit(": "), text("description", "")),
        "flow": F.concat(F.lit("  - "), text("name"), F.lit(": "), text("value"), F.lit(" "), text("unit"), F.lit(" ("), text("flow_type"), F.lit("/"), text("category"), F.lit(")")),
        "parameter": F.concat(F.lit("  - "), text("parameter_name"), F.lit(": "), text("parameter_value"), F.lit(" "), text("parameter_unit", "")),
    }
    line = F.coalesce(*[F.when(F.col("record_type") == kind, said) for kind, said in lines.items()])
    asks = F.coalesce(_is_summary(F.col) if asks is None else asks, F.lit(False))
    # the join below would leave out null sessions on one of its sides alone, and both would be dealt
    rows = actions.where(F.col("session_id").isNotNull()).select("session_id", "seq", "record_type", line.alias("line"), asks.alias("asks"))
    rows = Dealt(rows, ["session_id"], ["seq"], parts, actions, begun).carry(nth=("total", F.col("asks").cast("int"))).rows
    # an action that asks ends a piece, and is itself of the next one
    seq = actions.schema["seq"].dataType.simpleString()
    own = F.struct((F.col("nth") + F.col("asks").cast("int")).alias("nth"), F.lit(False).alias("ends"), F.lit(None).cast(seq).alias("ask"), F.struct("seq", "line").alias("l"), F.col("record_type").alias("kind"))
    end = F.when(F.col("asks"), F.struct("nth", F.lit(True).alias("ends"), F.col("seq").alias("ask"), F.lit(None).cast(f"struct<seq:{seq},line:string>").alias("l"), F.lit(None).cast("string").alias("kind")))
    met = rows.select("session_id", F.inline(F.array_compact(F.array(own, end))))
    joined = {kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("l")))), lambda x: x["line"]), "\n") for kind in lines}
    piece = [F.struct(F.count_if(F.col("kind") == kind).alias("n"), said.alias("lines")).alias(kind) for kind, said in joined.items()]
    pieces = met.groupBy("session_id", "nth").agg(F.max("ends").alias("ends"), F.max("ask").alias("ask"), F.count("l").alias("n"), *piece)
    asked = pieces.where("ends").select(F.col("session_id").alias("__s"), F.col("nth").alias("__nth"), F.col("ask").alias("seq"))
    earlier = asked.join(pieces.drop("ends", "ask"), (F.col("session_id") == F.col("__s")) & (F.col("nth") <= F.col("__nth")), "left")
    told = earlier.groupBy("__s", "__nth", "seq").agg(F.array_sort(F.collect_list(F.struct("nth", *lines))).alias("l"), F.sum("n").alias("n"))
    of = lambda kind: F.filter(F.transform("l", lambda x: x[kind]), lambda x: x["n"] > 0)
    count = lambda kind: F.aggregate(of(kind), F.lit(0).cast("long"), lambda n, x: n + x["n"])
    told = told.select("__s", "seq", "n", *(F.array_join(F.transform(of(kind), lambda x: x["lines"]), "\n").alias(kind) for kind in lines), *(count(kind).alias(f"__{kind}") for kind in lines))
    block = lambda head, kind: F.when(F.col(f"__{kind}") > 0, F.concat(F.lit(head + "\n"), kind, F.lit("\n\n"))).otherwise("")
    counts = F.concat(F.lit("Scopes: "), "__scope", F.lit(", Flows: "), "__flow", F.lit(", Parameters: "), "__parameter", F.lit("\n\n"))
    blocks = F.concat(block("LCA Scope:", "scope"), block("Recorded Flows:", "flow"), block("Recorded Parameters:", "parameter"))
    whole = F.concat(F.lit("Total Actions: "), (F.col("__scope") + F.col("__flow") + F.col("__parameter")).cast("string"), F.lit("\n"), counts, blocks)
    # lines are joined by ends of lines, so the last one has none
    summary = F.when(F.col("n") > 0, F.substr(whole, F.lit(1), F.length(whole) - 1)).otherwise("No previous records in this session.")
    return told.select(F.col("__s").alias("session_id"), "seq", summary.alias("summary"))


# --- the machine -----------------------------------------------------------------------------------------------------
def _row(k: int, role: str, content=None, reasoning=None, calls=None, seq=None) -> Column:
    """A message of an action, which is at ``seq``, and its place ``k`` among the action's messages."""
    null = F.lit(None).cast("string")
    message = F.struct(
        F.lit(role).alias("role"), (null if content is None else content).alias("content"), (null if reasoning is None else reasoning).alias("reasoning_content"),
        (F.lit(None).cast("array<string>") if calls is None else calls).alias("tool_calls"),
    )
    return F.struct((F.col("seq") if seq is None else seq).alias("seq"), F.lit(k).alias("k"), message.alias("m"))


def _rows(pieces: DataFrame) -> DataFrame:
    """A row for each message."""
    return pieces.select("session_id", F.inline("said")).select("session_id", "seq", "k", "m.*")


def told(actions: DataFrame, parts: int | None = None, begun: DataFrame | bool | None = True) -> DataFrame:
    """Actions but previews, each with what it says in a conversation.

    ``kind``: pivot, skip or record. ``asked``, ``found``: its search and the chunks found. ``searches``: whether it says
    the search, which is where its query differs from the last one that was said. ``pending``: the placeholder of a skip that is
    the last message so far, which the next search or record takes on. ``stays``: whether a skip's own placeholder
    remains without a call. ``nth``: how many of its session came before it; ``later``: whether another comes after. Rows
    are dealt once, a session of any length into ranges, as by :class:`millrace.operators.ordered.Dealt`.
    """
    rows = actions.where(F.coalesce(F.col("record_type") != "document_preview", F.lit(True)))
    pivot = (F.col("record_type") == "pivot") | F.coalesce(F.col("intent") == "pivot_query", F.lit(False))
    kind = F.when(pivot, "pivot").when(F.col("intent") == "smart_skip", "skip").otherwise("record")
    rows = rows.withColumn("kind", kind)
    none = F.array().cast(_CHUNKS)
    slim = lambda c: c if actions.schema[c].dataType.simpleString() == _CHUNKS else F.transform(c, lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["content"].alias("content")))
    context = F.coalesce(slim("search_context"), none)
    skipped = F.when((F.size(context) == 0) & F.col("skipped_chunk").isNotNull(), F.array(F.struct("skipped_chunk.chunk_id", "skipped_chunk.content"))).otherwise(context)
    rows = rows.withColumn("asked", F.when(F.col("kind") == "pivot", F.col("failed_query")).otherwise(F.col("search_query")))
    rows = rows.withColumn("found", F.when(F.col("kind") == "pivot", F.coalesce(slim("failed_context"), none)).when(F.col("kind") == "skip", skipped).otherwise(context))
    may = (F.coalesce(F.size("asked"), F.lit(0)) > 0) & ((F.col("kind") != "record") | (F.size("found") > 0))
    dealt = Dealt(rows, ["session_id"], ["seq"], parts, actions, begun).with_column("__may", F.when(may, F.col("asked")))
    dealt.carry(before_query=("before", F.col("__may")), nth=("total", F.lit(1)), later=("after", F.lit(True)))
    dealt.with_column("searches", F.col("__may").isNotNull() & ~F.col("__may").eqNullSafe(F.col("before_query")))
    records = (F.col("kind") == "record") & (F.col("record_type").isin(*RECORDS) | _is_summary(F.col))
    dealt.with_column("records", F.coalesce(records, F.lit(False)))
    placeholder = F.concat(F.lit("[SMART_SKIP_PLACEHOLDER: "), F.coalesce("category", F.lit("Unknown")), F.lit(" - "), F.coalesce("skip_reason", F.lit("already_recorded")), F.lit("]"))
    dealt.with_column("placeholder", F.when(F.col("kind") == "skip", placeholder))
    speaks = F.when(F.col("searches") | F.col("records"), F.struct("kind", "placeholder"))
    rows = dealt.carry(__last=("before", speaks), __next=("after", speaks["kind"])).rows
    stays = (F.col("kind") == "skip") & F.col("searches") & (F.col("__next").isNull() | (F.col("__next") == "pivot"))
    more = {"pending": F.col("__last")["placeholder"], "stays": stays, "later": F.col("later").isNotNull()}
    return rows.withColumns(more).select(*actions.columns, "kind", "asked", "found", "searches", "records", "placeholder", "nth", *more)


def chat_rows(actions: DataFrame, parts: int | None = None) -> DataFrame:
    """Message rows (session_id, seq, k, role, content, reasoning_content, tool_calls: JSON texts) of each session's actions.

    ``actions`` are the log: session_id, seq, action_id, record_type, intent, category, name, value, unit, flow_type, note,
    process_name, cas_number, location, parameter_name, parameter_value, parameter_unit, description, source_content,
    calculation_expression, calculation_result, calculation_unit, data_dependencies, search_query, search_context,
    selected_chunk, failed_query, failed_context, skip_reason, skipped_chunk. Searches that repeat the last one are not
    said again; failed ones are said without a record; skips say their search and a placeholder of reasoning, which
    the next call takes on. Types that no tool makes give their search alone. A session that ends with a summary, or
    with a record after at most ``SHORT_SESSION`` actions, ends with an empty reply, to be filled in.
    """
    return _rows(chat_pieces(actions, parts))


def chat_pieces(actions: DataFrame, parts: int | None = None) -> DataFrame:
    """The same before it is rows: (session_id, said), the messages of an action as one value, told summaries by themselves."""
    begun, empty = borders(actions, ["session_id"], ["seq"], parts), F.lit("")
    rows = told(actions, parts, begun)
    takes = F.when(F.col("kind") != "pivot", F.coalesce("pending", empty)).otherwise(empty)
    known = F.coalesce(F.col("record_type").isin(*RECORDS), F.lit(False))
    ends = ~F.col("later") & ((F.col("record_type") == "summary_check") | (known & (F.col("nth") < SHORT_SESSION)))
    here = known | F.col("session_id").isNull()  # what has no session has no summary either
    # texts are columns first, so that they are compiled; within what makes rows of them they would be interpreted
    texts = {
        "__search": F.when(F.col("searches"), call("search_document", search_arguments(F.col("session_id"), F.col("asked")))),
        "__found": F.when(F.col("searches"), search_response(F.col("asked"), F.col("found"))),
        "__call": F.when(F.col("records"), record_call(F.col)), "__answer": F.when(F.col("records") & here, record_response(F.col, F.lit(None).cast("string"))),
        "__takes": takes, "__here": here, "__ends": ends,
    }
    rows = rows.select("session_id", "seq", "searches", "stays", "records", "placeholder", *(c.alias(n) for n, c in texts.items()))
    said = F.array(
        F.when(F.col("searches"), _row(0, "assistant", reasoning=F.col("__takes"), calls=F.array("__search"))), F.when(F.col("searches"), _row(1, "tool", F.col("__found"))),
        F.when(F.col("stays"), _row(2, "assistant", reasoning=F.col("placeholder"), calls=F.array().cast("array<string>"))),
        F.when(F.col("records"), _row(3, "assistant", reasoning=F.when(F.col("searches"), empty).otherwise(F.col("__takes")), calls=F.array("__call"))),
        F.when(F.col("records") & F.col("__here"), _row(4, "tool", F.col("__answer"))), F.when(F.col("__ends"), _row(5, "assistant", content=empty, reasoning=empty)),
    )
    # answers that tell a summary need no other column of their actions, so these stay where they are
    pivot = (F.col("record_type") == "pivot") | F.coalesce(F.col("intent") == "pivot_query", F.lit(False))
    aside = F.coalesce(pivot | (F.col("intent") == "smart_skip"), F.lit(False)) | F.coalesce(F.col("record_type") == "document_preview", F.lit(False))
    summaries = earlier_summaries(actions, parts, _is_summary(F.col) & ~known & ~aside, begun)
    answer = F.array(_row(4, "tool", content=response({"success": F.lit("true"), "summary": json_of(F.col("summary"))})))
    return rows.select("session_id", F.array_compact(said).alias("said")).unionByName(summaries.select("session_id", answer.alias("said")))


def system_prompts(actions: DataFrame, base: str, injection: str = INJECTION, most: int | None = None) -> DataFrame:
    """(session_id, prompt): ``base`` and, where a session has a preview of its document, that preview.

    The first ``document_preview`` of a session counts (document_name, document_preview with chunk_0 and chunk_1, each
    chunk_id and content). Chunks without content are left out; with ``most``, longer ones are cut to so many characters.
    """
    first = actions.where("record_type = 'document_preview'").groupBy(F.col("session_id").alias("__s")).agg(F.min_by(F.struct("document_name", "document_preview"), "seq").alias("__p"))
    rows = actions.select("session_id").distinct().join(first, F.col("session_id") == F.col("__s"), "left")
    cut = lambda c: c if most is None else F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)

    def filled(form: str, *values: Column) -> Column:
        pieces = [F.lit(form.split("{0}")[0]), values[0]]
        rest = form.split("{0}")[1]
        return F.concat(*pieces, F.lit(rest)) if len(values) == 1 else F.concat(*pieces, F.lit(rest.split("{1}")[0]), values[1], F.lit(rest.split("{1}")[1]))

    chunk = lambda i: F.col("__p")["document_preview"][f"chunk_{i}"]["content"]
    shown = [F.when(F.length(chunk(i)) > 0, filled(PREVIEWS[i], cut(chunk(i)))).otherwise("") for i in (0, 1)]
    about = filled(DOCUMENT, F.coalesce(F.col("__p")["document_name"], F.lit("Unknown Document")), F.substring("session_id", 1, 8))
    prompt = F.concat(F.lit(base), F.when(F.col("__p").isNotNull(), F.concat(about, *shown, F.lit(injection))).otherwise(""))
    return rows.select("session_id", prompt.alias("prompt"))


def _samples(pieces: DataFrame, prompts: DataFrame) -> DataFrame:
    """session_id, messages (role, content, reasoning_content, tool_calls) and n: the prompt, an empty question, and ``pieces`` in order."""
    seq = F.lit(None).cast(pieces.schema["said"].dataType.elementType["seq"].dataType)
    opening = F.array(_row(-2, "system", content=F.col("prompt"), seq=seq), _row(-1, "user", content=F.lit(""), seq=seq))
    every = pieces.unionByName(prompts.select("session_id", opening.alias("said")))
    # one by one in order, as a told summary comes between the other messages of its action
    messages = F.sort_array(F.flatten(F.collect_list("said")))["m"]
    return every.groupBy("session_id").agg(messages.alias("messages")).select("session_id", "messages", F.size("messages").cast("long").alias("n"))


def chat_samples(actions: DataFrame, base: str, parts: int | None = None) -> DataFrame:
    """One sample of nested messages for each session. A session's sample is one value, as it is one line of the file."""
    return _samples(chat_pieces(actions, parts), system_prompts(actions, base))


def answer(calculated: Column) -> Column:
    """A record in a sentence: record_type, name, value, unit, category, flow_type, parameter_name and description."""
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    amount, name = F.concat(c("value"), F.lit(" "), c("unit")), F.lower(c("name"))
    said = lambda before, after: F.concat(F.lit(before), amount, F.lit(" of "), name, F.lit(after))
    plain = F.concat(F.lit("The "), name, F.lit(" is "), amount, F.lit("."))
    output = (
        F.when(F.col("category") == "Product", said("The process produced ", ".")).when(F.col("category") == "Waste", said("The process generated ", " waste."))
        .when(F.col("category") == "Emission", said("The process emitted ", ".")).otherwise(said("The output is ", "."))
    )
    flow = (
        F.when(calculated, F.concat(F.lit("Based on the calculation, the "), name, F.lit(" is "), amount, F.lit(".")))
        .when(F.col("flow_type") == "Input", said("The process consumed ", ".")).when(F.col("flow_type") == "Output", output).otherwise(plain)
    )
    scope = F.concat(F.lit("The functional unit is: "), F.coalesce(F.nullif("description", F.lit("")), c("parameter_name")))
    parameter = F.concat(F.lit("The "), F.lower(c("parameter_name")), F.lit(" is "), amount, F.lit("."))
    r = F.col("record_type")
    return F.when(r == "flow", flow).when(r == "scope", scope).when(r == "parameter", parameter).otherwise("I found the requested information in the document.")


def qa_pairs(actions: DataFrame) -> DataFrame:
    """Records with whether an earlier calculation of their session gave them, and their answers."""
    calc = actions.where("record_type = 'calculation'").select(F.col("session_id").alias("__s"), F.col("action_id").alias("__a"), F.col("seq").alias("__q"))
    rows = actions.where(F.col("record_type").isin("flow", "scope", "parameter"))
    rows = rows.join(calc, (F.col("session_id") == F.col("__s")) & (F.col("link_to") == F.col("__a")) & (F.col("__q") < F.col("seq")), "left")
    was = F.col("__a").isNotNull()
    return rows.withColumn("calculated", was).withColumn("answer", answer(was)).drop("__s", "__a", "__q")


def qa_rows(actions: DataFrame, parts: int | None = None) -> DataFrame:
    """Message rows of the question-answer form: the searches with what they found, and one answer of all records.

    Here a search is said whether or not it found anything, a skip finds the chunk that it skipped, and records are no calls.
    """
    return _rows(qa_pieces(actions, parts))


def qa_pieces(actions: DataFrame, parts: int | None = None) -> DataFrame:
    """The same before it is rows: (session_id, said), each search with what it found, and the answer, as one value."""
    context = F.coalesce("search_context", F.array().cast(_CHUNKS))
    skip = F.col("intent") == "smart_skip"
    found = F.when(skip, F.when(F.col("skipped_chunk").isNotNull(), F.array(F.struct("skipped_chunk.chunk_id", "skipped_chunk.content"))).otherwise(F.array().cast(_CHUNKS))).otherwise(context)
    rows = actions.where(F.coalesce(F.col("record_type") != "document_preview", F.lit(True)))
    pivot = (F.col("record_type") == "pivot") | F.coalesce(F.col("intent") == "pivot_query", F.lit(False))
    rows = rows.withColumn("asked", F.when(pivot, F.col("failed_query")).otherwise(F.col("search_query"))).withColumn("found", F.when(pivot, F.col("failed_context")).otherwise(found))
    rows = rows.withColumn("__may", F.when(F.coalesce(F.size("asked"), F.lit(0)) > 0, F.col("asked")))
    rows = carried(rows, ["session_id"], ["seq"], parts, before_query=("before", F.col("__may")))
    searches = F.col("__may").isNotNull() & ~F.col("__may").eqNullSafe(F.col("before_query"))
    search = F.array(call("search_document", search_arguments(F.col("session_id"), F.col("asked"))))
    said = F.array(_row(0, "assistant", reasoning=F.lit(""), calls=search), _row(1, "tool", search_response(F.col("asked"), F.col("found"))))
    said = rows.where(searches).select("session_id", said.alias("said"))
    answers = qa_pairs(rows.where(~pivot & F.coalesce(~skip, F.lit(True)))).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "answer"))).alias("a"), F.max("seq").alias("seq"))
    last = actions.groupBy(F.col("session_id").alias("__s")).agg(F.max("seq").alias("__last"))
    text = F.array_join(F.transform("a", lambda x: x["answer"]), " ")
    reply = F.array(_row(5, "assistant", content=text, reasoning=F.lit("")))
    answers = answers.drop("seq").join(last, F.col("session_id") == F.col("__s")).withColumnRenamed("__last", "seq")
    return said.unionByName(answers.select("session_id", reply.alias("said")))


def qa_samples(actions: DataFrame, base: str, parts: int | None = None) -> DataFrame:
    """One question-answer sample for each session, previews cut to 500 characters."""
    return _samples(qa_pieces(actions, parts), system_prompts(actions, base, QA_INJECTION, 500))
