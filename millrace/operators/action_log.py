"""Operators over the append-only action log: one row for each action, keyed by session_id and seq.

All of them group or order by session alone, so one shuffle on session_id serves a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.sources.tables import checkpointed

RECORDS = ("scope", "flow", "parameter", "calculation", "pivot", "smart_skip")
INTENTS = ("select_best", "refine_same", "pivot_query", "calculate", "smart_skip")
LLM_VIEW = ("scope", "flow", "parameter")
#: Names under which the functional unit is recorded.
UNIT_SCOPES = ("Function Unit", "Functional Unit")


def by_seq():
    return Window.partitionBy("session_id").orderBy("seq")


def view(actions: DataFrame, name: str = "workbench") -> DataFrame:
    """``llm`` sees scopes, flows and parameters; ``workbench`` sees all."""
    return actions.where(F.col("record_type").isin(*LLM_VIEW)) if name == "llm" else actions


def number(action_id: Column) -> Column:
    """The number in an action's id, of any length; null for special ids."""
    return F.regexp_extract(action_id, r"^ACT_(\d+)$", 1).try_cast("long")


def derived_link(session: WindowSpec) -> Column:
    """The action that an action links to by default, in a session's order: the one before it, if it follows from that.

    Pivots, skips, calculations and refinements do, the best choice after a pivot, and a flow after a calculation.
    """
    before = F.lag("intent").over(session)
    follows = (
        F.col("record_type").isin("pivot", "smart_skip", "calculation") | (F.col("intent") == "refine_same")
        | ((F.col("intent") == "select_best") & (before == "pivot_query")) | ((F.col("record_type") == "flow") & (before == "calculate"))
    )
    return F.when(follows, F.lag("action_id").over(session))


def linked() -> Column:
    return F.col("link_to").isNotNull() & (F.col("link_to") != "")


def sessions(actions: DataFrame) -> DataFrame:
    """Each session once, with its flows counted and the scope recorded first."""
    first = F.min_by("name", F.when(F.col("record_type") == "scope", F.col("seq")))
    return actions.groupBy("session_id").agg(F.count_if(F.col("record_type") == "flow").alias("flows"), first.alias("scope"))


def record_counts(actions: DataFrame) -> DataFrame:
    """Actions by record type, zero-filled, and how many are linked."""
    counts = [F.count_if(F.col("record_type") == r).alias(f"n_{r}") for r in RECORDS]
    kinds = [F.count_if(linked() & (F.col("record_type") == r)).alias(f"linked_{r}") for r in ("parameter", "calculation")]
    return actions.groupBy("session_id").agg(F.count("*").alias("n_actions"), *counts, F.count_if(linked()).alias("linked_all"), *kinds)


def intent_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("session_id", "intent").agg(F.count("*").alias("n"))


def quality(actions: DataFrame) -> DataFrame:
    """Mean evidence, to three digits, of flows that name a process: 1 with a source chunk, 0.5 without; and what is complete."""
    flow = F.col("record_type") == "flow"
    scored = F.when(flow & F.col("process_name").isNotNull(), F.when(F.col("chunk_id").isNotNull(), 1.0).otherwise(0.5))
    has = lambda c: F.coalesce(F.bool_or(flow & c), F.lit(False))
    return actions.groupBy("session_id").agg(
        F.round(F.avg(scored), 3).alias("quality"),
        F.coalesce(F.bool_or((F.col("record_type") == "scope") & F.col("name").isin(*UNIT_SCOPES)), F.lit(False)).alias("has_unit"),
        has(F.col("category") == "Product").alias("has_product"),
        has(F.col("process_name").isNotNull()).alias("has_process"),
        F.bool_or(F.col("record_type") == "parameter").alias("has_parameter"),
    )


def scope_last_write(actions: DataFrame) -> DataFrame:
    """Scope parameters by name; the last write wins."""
    scopes = actions.where("record_type = 'scope'")
    return scopes.groupBy("session_id", "name").agg(F.max_by("value", "seq").alias("value"), F.max_by("action_id", "seq").alias("action_id"), F.count("*").alias("writes"))


def ordered_text(item: Column, sep: str, when: Column | None = None) -> Column:
    """An aggregate: the items in order of seq, joined."""
    entry = F.struct("seq", item.alias("item"))
    rows = F.collect_list(entry if when is None else F.when(when, entry))
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["item"]), sep)


def skip_analysis(actions: DataFrame) -> DataFrame:
    """Skipped categories and the chunks they name, in order."""
    skips = actions.where("record_type = 'smart_skip'")
    return skips.groupBy("session_id").agg(
        F.count("*").alias("skips"), ordered_text(F.col("category"), ",").alias("categories"), ordered_text(F.coalesce("chunk_id", F.lit("-")), ",").alias("chunks"),
        F.countDistinct("category").alias("distinct_categories"),
    )


def parameter_lists(actions: DataFrame) -> DataFrame:
    """Parameters and calculations of a session as ordered lists."""
    line = F.concat(F.col("action_id"), F.lit(":"), F.col("name"), F.lit("="), F.coalesce("k", F.lit(0)).cast("string"))
    wanted = actions.where(F.col("record_type").isin("parameter", "calculation"))
    return wanted.groupBy("session_id").agg(
        ordered_text(line, ";", F.col("record_type") == "parameter").alias("parameters"),
        ordered_text(F.concat(line, F.lit("<-"), F.coalesce("link_to", F.lit(""))), ";", F.col("record_type") == "calculation").alias("calculations"),
    )


def summary_text(actions: DataFrame, which: str, before: str | None = None) -> DataFrame:
    """The session as text: one line for each action of the view, up to an action id if one is given."""
    rows = view(actions, which)
    if before is not None:
        rows = rows.where(number(F.col("action_id")) < int(before.split("_")[1]))
    line = F.concat(F.lit("["), F.col("action_id"), F.lit("] "), F.col("record_type"), F.lit(" "), F.col("name"), F.lit(" ("), F.col("category"), F.lit(")"))
    return rows.groupBy("session_id").agg(ordered_text(line, "\n").alias("summary"), F.count("*").alias("lines"))


def summary_snapshot(actions: DataFrame) -> DataFrame:
    """Recorded flows flattened with counts; parameters are not among ``total_actions``."""
    of = lambda r: F.count_if(F.col("record_type") == r)
    flow = F.col("record_type") == "flow"
    return actions.groupBy("session_id").agg(
        (of("scope") + of("flow") + of("calculation")).alias("total_actions"),
        ordered_text(F.concat_ws(": ", "category", "name"), "|", flow).alias("flows"),
        F.countDistinct(F.when(flow, F.col("category"))).alias("flow_categories"),
    )


def next_ids(actions: DataFrame) -> DataFrame:
    """Well-formed ids, their numbers, and the id that the session's next action gets. Numbers from 10,000 on have more digits."""
    good = actions.where(F.rlike("action_id", F.lit(r"^ACT_(\d{4}|[1-9]\d{4,})$")))
    last = F.max(F.split_part("action_id", F.lit("_"), F.lit(2)).try_cast("int"))
    return good.groupBy("session_id").agg(last.alias("last_number"), F.count("*").alias("n")).withColumn("next_id", F.format_string("ACT_%04d", F.col("last_number") + 1))


def pivots(actions: DataFrame) -> DataFrame:
    """Pivots after pivots, and pivots that the next action succeeds: select_best, linked to the pivot."""
    pivot = F.col("intent") == "pivot_query"
    rows = actions.withColumn("__twice", pivot & (F.lag("intent").over(by_seq()) == "pivot_query")).withColumn(
        "__won", pivot & (F.lead("intent").over(by_seq()) == "select_best") & (F.lead("link_to").over(by_seq()) == F.col("action_id"))
    )
    return rows.groupBy("session_id").agg(
        F.count_if(pivot).alias("pivots"), F.count_if(F.col("__twice")).alias("consecutive"), F.count_if(F.col("__won")).alias("successes")
    )


def recent(actions: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` actions of each session, numbered from the oldest of these."""
    back = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    rows = actions.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= n)
    return rows.withColumn("place", F.row_number().over(by_seq())).select("session_id", "action_id", "place", "intent", "record_type")


def guards(actions: DataFrame, pivots_in: int = 10, records_in: int = 20, most_pivots: int = 3, most_records: int = 10) -> DataFrame:
    """At each action: pivots among the last 10 and records among the last 20, and whether a guard trips."""
    p = F.count_if(F.col("intent") == "pivot_query").over(by_seq().rowsBetween(1 - pivots_in, 0))
    r = F.count_if(F.col("record_type").isin("flow", "parameter")).over(by_seq().rowsBetween(1 - records_in, 0))
    rows = actions.select("session_id", "seq", p.alias("recent_pivots"), r.alias("recent_records"))
    return rows.withColumn("blocked", (F.col("recent_pivots") >= most_pivots) | (F.col("recent_records") >= most_records))


def chains(actions: DataFrame) -> DataFrame:
    """For each action its chain's root and how many links it is away; a link to an action that is not there ends a chain.

    Each round follows every pointer to its pointer's end, until none moves: a chain of n links takes log2(n) rounds, and
    the links of all sessions move together. Links that form a ring have no root; rounds end once no chain could be longer.
    """
    at = actions.select("session_id", "action_id", F.when(linked(), F.col("link_to")).alias("to"))
    at = at.select("session_id", "action_id", F.coalesce("to", "action_id").alias("root"), F.col("to").isNotNull().cast("long").alias("depth"))
    at = checkpointed(at)
    for _ in range(at.count().bit_length()):
        ends = at.where("depth > 0").select(F.col("session_id").alias("__s"), F.col("action_id").alias("__a"), F.col("root").alias("__r"), F.col("depth").alias("__d"))
        at = at.join(ends, (F.col("session_id") == F.col("__s")) & (F.col("root") == F.col("__a")) & (F.col("depth") > 0), "left").select(
            "session_id", "action_id", F.coalesce("__r", "root").alias("root"), (F.col("depth") + F.coalesce("__d", F.lit(0))).alias("depth"), F.col("__r").isNotNull().alias("__moved")
        )
        at = checkpointed(at)
        if at.where("__moved").isEmpty():
            break
        at = at.drop("__moved")
    return at.select("session_id", "action_id", "root", "depth")


#: Names of scope parameters, the last of former versions.
SCOPE_NAMES = ("Function Unit", "System Boundary", "Geographical Scope", "Functional Unit")


def validate_scopes(scopes: DataFrame) -> DataFrame:
    """Adds ``error``: null where ``parameter_name`` is a scope parameter's."""
    valid = F.coalesce(F.col("parameter_name").isin(*SCOPE_NAMES), F.lit(False))
    return scopes.withColumn("error", F.when(~valid, "invalid parameter_name"))


def evidence(chunk_id: Column, link_to: Column) -> Column:
    """Where a record comes from: a document's chunk, a calculation it links to, or neither, which warns and never rejects."""
    return F.when(chunk_id.isNotNull() & (chunk_id != ""), "document").when(link_to.startswith("ACT_"), "calculation").otherwise("none")


def validate(records: DataFrame, inputs, outputs) -> DataFrame:
    """Adds ``error`` (null where a record is valid) and ``evidence`` (from ``chunk_id`` and ``link_to``)."""
    error = (
        F.when(~F.col("flow_type").isin("Input", "Output") | F.col("flow_type").isNull(), "flow_type must be Input or Output")
        .when(F.col("category").isNull() | ~F.col("category").isin(*inputs, *outputs), "unknown category")
        .when((F.col("flow_type") == "Input") & ~F.col("category").isin(*inputs), "not an input category")
        .when((F.col("flow_type") == "Output") & ~F.col("category").isin(*outputs), "not an output category")
        .when(F.col("value").isNull(), "value is missing")
    )
    return records.withColumn("error", error).withColumn("evidence", evidence(F.col("chunk_id"), F.col("link_to")))


def repeated_queries(actions: DataFrame) -> DataFrame:
    """Whether each action emits its query: only one that differs from the last one emitted in its session."""
    before = F.last("search_query", ignorenulls=True).over(by_seq().rowsBetween(Window.unboundedPreceding, -1))
    return actions.select("session_id", "seq", "search_query", F.coalesce(~F.col("search_query").eqNullSafe(before), F.lit(False)).alias("emitted"))


def summary(actions: DataFrame) -> DataFrame:
    """The wide session summary in one aggregation: counts by record type, intent and category, quality and times."""
    of = lambda c, v, n: F.count_if(F.col(c) == v).alias(n)
    flow = F.col("record_type") == "flow"
    scored = F.when(flow & F.col("process_name").isNotNull(), F.when(F.col("chunk_id").isNotNull(), 1.0).otherwise(0.5))
    return actions.groupBy("session_id").agg(
        F.count("*").alias("actions"), *[of("record_type", r, f"n_{r}") for r in RECORDS], *[of("intent", i, f"i_{i}") for i in INTENTS],
        F.count_if(linked()).alias("linked"), F.round(F.avg(scored), 3).alias("quality"), F.min("created_at").alias("first_at"),
        F.max_by("action_id", "seq").alias("last_action"), F.countDistinct(F.when(flow, F.col("category"))).alias("flow_categories"),
    )


def scenario() -> Column:
    """The suggestion scenario of a request, null where none fits.

    A request has intent, tool, last_intent, flow_type and the flags uncertain, ambiguous, scope_unclear, from_calculation
    and inference_required (null: false).
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    side = F.when(F.col("flow_type") == "Input", "input").when(F.col("flow_type") == "Output", "output")
    inferred = F.coalesce(F.concat(F.lit("record_flow_"), side, F.lit("_with_inference")), F.lit("record_parameter_with_inference"))
    parameter = (
        F.when(flag("uncertain"), "record_parameter_uncertain").when(flag("ambiguous"), "record_parameter_ambiguous")
        .when(flag("inference_required"), "record_parameter_with_inference").otherwise("record_parameter_direct")
    )
    flow = (
        F.when(flag("scope_unclear"), "record_flow_uncertain")
        .when(flag("from_calculation") | F.coalesce(F.col("last_intent") == "calculate", F.lit(False)), "record_flow_from_calculation")
        .when(flag("inference_required"), inferred).otherwise(F.coalesce(F.concat(F.lit("record_flow_"), side), F.lit("record_flow_uncertain")))
    )
    pivot = F.when(flag("ambiguous"), "record_parameter_ambiguous").otherwise("pivot_query_no_results")
    return (
        F.when(F.col("intent") == "refine_same", "refine_same_chunk").when(F.col("intent") == "pivot_query", pivot)
        .when(F.col("tool") == "record_parameter", parameter).when(F.col("tool") == "record_process_flow", flow)
    )


def scenario_payload(s: Column) -> Column:
    """What scenario ``s`` tells its suggestion: a map. Requests have chunk_id, search_query, name, value, unit and raw_evidence."""
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    of = lambda **pairs: F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    known = F.coalesce(F.col("name") != "", F.lit(False)) & F.col("value").isNotNull()
    plain, told = of(name=c("name"), value=c("value"), unit=c("unit")), of(data=F.trim(F.concat_ws(" ", c("value"), c("unit"), c("name"))))
    raw = F.coalesce(F.col("raw_evidence"), F.concat(F.lit("Raw_"), c("name")))
    inferred = of(raw_evidence=raw, value=c("value"), unit=c("unit"), specific_material=c("name"))
    note = of(note=F.when(F.contains(F.lower(c("name")), F.lit("reuse")), "for Reuse").otherwise(""))
    parameter = F.when(~known, of(data=F.lit("the extracted parameter value"))).when(s == "record_parameter_direct", plain).when(s == "record_parameter_with_inference", inferred).otherwise(told)
    flow = F.when(~known, of(data=F.lit("the extracted flow data"))).when(s == "record_flow_uncertain", told).when(s.endswith("_with_inference"), F.map_concat(inferred, note)).otherwise(plain)
    return (
        F.when(s == "refine_same_chunk", of(chunk_id=F.coalesce(F.col("chunk_id"), F.lit("Unknown"))))
        .when(s.isin("pivot_query_no_results", "record_parameter_ambiguous"), of(query=F.coalesce(F.nullif("search_query", F.lit("")), F.lit("search query"))))
        .when(F.contains(s, F.lit("parameter")), parameter).when(F.contains(s, F.lit("flow")), flow)
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows in place of ``old`` ones with their keys, and the other old rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns).unionByName(new)


def clear_sessions(actions: DataFrame, gone: DataFrame) -> DataFrame:
    return actions.join(gone.select("session_id").distinct(), "session_id", "left_anti")
