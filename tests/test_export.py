"""Training samples against a plain machine that reads one session's actions in order; ordered values against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import chat, export, ordered

SCHEMA = (
    "session_id string, seq int, action_id string, record_type string, intent string, link_to string, category string, name string, value double, unit string, flow_type string, note string, "
    "process_name string, cas_number string, location string, parameter_name string, parameter_value double, parameter_unit string, description string, source_content string, "
    "calculation_expression string, calculation_result double, calculation_unit string, data_dependencies array<string>, search_query array<string>, "
    "search_context array<struct<chunk_id:string,content:string>>, selected_chunk struct<chunk_id:string,content:string>, failed_query array<string>, "
    "failed_context array<struct<chunk_id:string,content:string>>, skip_reason string, skipped_chunk struct<chunk_id:string,content:string>, document_name string, "
    "document_preview struct<chunk_0:struct<chunk_id:string,content:string>,chunk_1:struct<chunk_id:string,content:string>>"
)


def log(seed, sessions=12, longest=30):
    rng = random.Random(seed)
    chunk = lambda: {"chunk_id": f"c{rng.randrange(4)}", "content": rng.choice(["plain", 'with "quotes"\nand lines', "ünï 文"])}
    out = []
    for s in range(sessions):
        for i in range(rng.randrange(1, longest)):
            kind = rng.choice(["flow", "parameter", "calculation", "scope", "pivot", "skip", "skip", "summary_check", "note", "document_preview"])
            asked = rng.choice([["a"], ["a"], ["b"], ["a", "b"], [], None])
            out.append(dict(
                session_id=f"session-{s}", seq=i, action_id=f"ACT_{i + 1:04d}", record_type="smart_skip" if kind == "skip" else kind, intent={"skip": "smart_skip", "pivot": rng.choice(["pivot_query", None])}.get(kind, rng.choice(["select_best", None])),
                link_to=f"ACT_{rng.randrange(1, i + 2):04d}", category=rng.choice(["Gas", "Waste", "Product", "Emission", None]), name=rng.choice(["Argon", "Steel", ""]), value=rng.choice([1.5, 20.0, None]), unit=rng.choice(["kg", None]),
                flow_type=rng.choice(["Input", "Output", None]), note=rng.choice(["n", "", None]), process_name=rng.choice(["p", None]), cas_number=rng.choice(["7440", None]), location=rng.choice(["GLO", ""]),
                parameter_name="Power", parameter_value=2.5, parameter_unit=rng.choice(["W", None]), description=rng.choice(["one part", "", None]), source_content=None, calculation_expression="1 + 1", calculation_result=2.0,
                calculation_unit=None, data_dependencies=rng.choice([None, [], ["ACT_0001"]]), search_query=asked, search_context=rng.choice([None, [], [chunk()], [chunk(), chunk()]]), selected_chunk=rng.choice([None, chunk()]),
                failed_query=asked, failed_context=rng.choice([None, [chunk()]]), skip_reason=rng.choice(["duplicate", None]), skipped_chunk=rng.choice([None, chunk()]), document_name=rng.choice(["doc.pdf", None]),
                document_preview=rng.choice([None, {"chunk_0": chunk(), "chunk_1": None}, {"chunk_0": chunk(), "chunk_1": {"chunk_id": "1", "content": "y" * 600}}]),
            ))
    return out


def arguments(a, asked):
    return {"session_id": a["session_id"]} | ({"queries": asked} if len(asked) > 1 else {"query": asked[0]})


def answered(body):
    return f"<tool_response>\n{json.dumps(body, ensure_ascii=False, indent=2)}\n</tool_response>"


def searched(asked, found):
    body = {"success": True, "message": f"Found {len(found)} relevant results", "results": found}
    return answered(body | ({"queries": asked} if len(asked) > 1 else {"query": asked[0]}))


def summary(actions, a):
    before = [x for x in actions if x["seq"] < a["seq"]]
    if not before:
        return "No previous records in this session."
    of = lambda kind: [x for x in before if x["record_type"] == kind]
    lines = [f"Total Actions: {sum(len(of(t)) for t in ('scope', 'flow', 'parameter'))}", f"Scopes: {len(of('scope'))}, Flows: {len(of('flow'))}, Parameters: {len(of('parameter'))}", ""]
    for head, kind, line in (
        ("LCA Scope:", "scope", lambda x: f"  - {x['parameter_name']}: {x['description'] or ''}"),
        ("Recorded Flows:", "flow", lambda x: f"  - {x['name']}: {x['value']} {x['unit']} ({x['flow_type']}/{x['category']})"),
        ("Recorded Parameters:", "parameter", lambda x: f"  - {x['parameter_name']}: {x['parameter_value']} {x['parameter_unit'] or ''}"),
    ):
        if of(kind):
            lines += [head, *map(line, of(kind)), ""]
    return "\n".join(lines)


def record(actions, a):
    """The call of a record and its response."""
    chunk = a["selected_chunk"] or {"chunk_id": None, "content": None}
    more = lambda *names: {n: a[n] for n in names if a[n]}
    take = lambda *names: {n: a[n] for n in names}
    own = {"record_id": f"{a['session_id']}/{a['action_id']}", "action_id": a["action_id"], "session_id": a["session_id"]}
    kind, s = a["record_type"], take("session_id")
    if kind == "parameter":
        return ("record_parameter", s | take("parameter_name", "parameter_value", "parameter_unit") | {"selected_chunk": chunk} | more("note")), {"success": True, "message": f"Parameter recorded with action_id: {a['action_id']}", "new_action_id": a["action_id"]}
    if kind == "flow":
        call = s | take("flow_type", "category", "name", "value", "unit") | {"selected_chunk": chunk} | more("note", "process_name", "cas_number", "location")
        return ("record_process_flow", call), {"success": True, "message": f"Successfully recorded process flow: {a['name']}", "data": own | take("flow_type", "category", "name", "value", "unit")}
    if kind == "calculation":
        return ("execute_calculation", s | {"expression": a["calculation_expression"], "dependencies": a["data_dependencies"] or []}), {"success": True, "message": "Calculation executed successfully", "result": a["calculation_result"], "unit": a["calculation_unit"]}
    if kind == "scope":
        call = s | take("parameter_name", "description", "value", "unit", "source_content") | {"selected_chunk": chunk} | more("note")
        return ("define_lca_scope", call), {"success": True, "message": f"Successfully defined LCA scope: {a['parameter_name']}", "data": own | take("parameter_name")}
    return ("get_session_summary", s | {"format": "text"}), {"success": True, "summary": summary(actions, a)}


def machine(actions):
    """One message after the other, with the last query said and whether a skip is pending as state."""
    out, last, pending = [], None, None
    kept = [a for a in actions if a["record_type"] != "document_preview"]

    def say(calls, reasoning=""):
        nonlocal pending
        if pending is not None and reasoning == "":
            pending["calls"] = calls
        else:
            out.append({"role": "assistant", "reasoning": reasoning, "calls": calls})
        pending = None

    for a in kept:
        pivot = a["record_type"] == "pivot" or a["intent"] == "pivot_query"
        skip = not pivot and a["intent"] == "smart_skip"
        asked = a["failed_query"] if pivot else a["search_query"]
        found = (a["failed_context"] if pivot else a["search_context"]) or []
        if skip and not found and a["skipped_chunk"]:
            found = [a["skipped_chunk"]]
        if asked and asked != last and (pivot or skip or found):
            if pivot:
                pending = None
            say([("search_document", arguments(a, asked))])
            out.append({"role": "tool", "content": searched(asked, found)})
            last = asked
            if skip:
                pending = {"role": "assistant", "reasoning": f"[SMART_SKIP_PLACEHOLDER: {a['category'] or 'Unknown'} - {a['skip_reason'] or 'already_recorded'}]", "calls": []}
                out.append(pending)
        if pivot or skip or a["record_type"] not in ("parameter", "flow", "calculation", "scope", "summary_check"):
            continue
        call, response = record(actions, a)
        say([call])
        out.append({"role": "tool", "content": answered(response)})
    if kept and (kept[-1]["record_type"] == "summary_check" or (kept[-1]["record_type"] in ("flow", "parameter", "scope", "calculation") and len(kept) <= 5)):
        out.append({"role": "assistant", "reasoning": "", "content": ""})
    return out


def plain(message):
    out = {"role": message["role"]}
    if message["content"] is not None:
        out["content"] = message["content"]
    if message["reasoning_content"] is not None:
        out["reasoning"] = message["reasoning_content"]
    if message["tool_calls"] is not None:
        out["calls"] = [(c["name"], c["arguments"]) for c in map(json.loads, message["tool_calls"])]
    return out


def frame(spark, actions):
    schema = spark.createDataFrame([], SCHEMA).schema
    return spark.createDataFrame([tuple(a[f.name] for f in schema.fields) for a in actions], schema)


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 4), (3, 9)])
def test_chat_samples_against_the_machine(spark, seed, parts):
    actions = log(seed)
    got = export.chat_samples(frame(spark, actions).repartition(5), "BASE", parts).collect()
    sessions = {a["session_id"] for a in actions}
    assert {r["session_id"] for r in got} == sessions and len(got) == len(sessions)
    for r in got:
        own = [a for a in actions if a["session_id"] == r["session_id"]]
        messages = [plain(m) for m in r["messages"]]
        assert messages[0]["content"].startswith("BASE") and messages[1] == {"role": "user", "content": ""}
        assert messages[2:] == machine(own) and r["n"] == len(messages)


def test_one_session_with_a_third_of_all_rows(spark):
    """A long session is dealt into ranges, and none of them has it whole."""
    actions = log(7, sessions=20, longest=12) + [a | {"session_id": "long", "seq": i, "action_id": f"ACT_{i + 1:04d}"} for i, a in enumerate(log(8, sessions=40, longest=12))]
    own = [a for a in actions if a["session_id"] == "long"]
    rows = export.chat_rows(frame(spark, actions), 8).where("session_id = 'long'").orderBy("seq", "k").collect()
    assert [plain(r) for r in rows] == machine(own) and len(own) > len(actions) / 3
    numbered = ordered.carried(frame(spark, actions).select("session_id", "seq"), ["session_id"], ["seq"], 8, n=("total", F.lit(1)))
    sizes = numbered.where("session_id = 'long'").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < len(own) * 0.7


def test_rows_are_dealt_once_by_session(spark):
    """Sessions of few actions are dealt by session alone and nothing is written; split into ranges they say the same."""
    actions = log(11, sessions=25, longest=40)
    made = export.chat_rows(frame(spark, actions))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "__part" not in plan and sum("RepartitionByExpression" in line for line in plan.splitlines()) == 3  # whole actions, lines of summaries, what asks for them
    said = lambda df: sorted(map(repr, df.collect()))
    assert said(made) == said(export.chat_rows(frame(spark, actions), 16))
    asks = {(a["session_id"], a["seq"]) for a in actions if a["record_type"] == "summary_check"}
    told = {(r["session_id"], r["seq"]): r["summary"] for r in export.earlier_summaries(frame(spark, actions), 5).collect()}
    assert set(told) == asks and all(told[a["session_id"], a["seq"]] == summary([x for x in actions if x["session_id"] == a["session_id"]], a) for a in actions if a["record_type"] == "summary_check")


def test_samples_of_dealt_rows(spark):
    """Samples are put together of rows that nothing wrote or split before; split sessions give the same ones."""
    actions = log(12, sessions=20, longest=30)
    made = export.chat_samples(frame(spark, actions), "BASE")
    assert "__part" not in made._jdf.queryExecution().optimizedPlan().toString()
    samples = lambda df: {r["session_id"]: (r["n"], r["messages"]) for r in df.collect()}
    assert samples(made) == samples(export.chat_samples(frame(spark, actions), "BASE", 16))


def test_samples_make_each_text_once(spark, monkeypatch):
    """Messages are grouped by action and not one by one, JSON is written once for an object, and ranges are asked for once."""
    asked, ask = [], ordered.borders
    for module in (ordered, export):
        monkeypatch.setattr(module, "borders", lambda *a, **b: asked.append(a) or ask(*a, **b), raising=False)
    plan = export.chat_samples(frame(spark, log(13)), "BASE")._jdf.queryExecution().optimizedPlan().toString()
    assert len(asked) == 1
    assert plan.count("Generate inline") == 2  # both sides of told summaries; what actions say is no row of its own
    assert plan.count("StructsToJsonEvaluator") < 60  # 138 where a text was written to know its length and again to cut it


def test_texts_that_look_like_json(spark):
    texts = ["", "[", "]", "[]", "][", "[[x]]", "}", "{}", '"', '"]', "a\nb", None]
    df = spark.createDataFrame([(t, [t, t]) for t in texts], "t string, l array<string>")
    c = F.col("t")
    objects = export.compact({"a": c, "l": F.col("l")}), export.longer({"a": c}, "o", {"b": c, "c": c}, {"x": export.json_of(c), "y": F.when(c.isNotNull(), export.json_of(c))})
    for r in df.select("t", export.json_of(c).alias("j"), *(o.alias(f"o{i}") for i, o in enumerate(objects))).collect():
        t, text = r["t"], json.dumps(r["t"])
        assert r["j"] == text and r["o0"] == f'{{"a":{text},"l":[{text},{text}]}}'
        assert r["o1"] == f'{{"a":{text},"o":{{"b":{text},"c":{text}}},"x":{text}' + ("" if t is None else f',"y":{text}') + "}"
    numbers = spark.createDataFrame([(1.5, 20, True), (None, None, None)], "d double, i int, b boolean")
    assert [tuple(r) for r in numbers.select(*(export.json_of(F.col(n)) for n in "dib")).collect()] == [("1.5", "20", "true"), ("null", "null", "null")]


def test_actions_without_a_session(spark):
    """They are one sample; what they ask for is answered without a summary, once."""
    actions = log(14, sessions=1, longest=40) + [a | {"session_id": None} for a in log(15, sessions=1, longest=60)]
    rows = [r for r in export.chat_rows(frame(spark, actions)).collect() if r["session_id"] is None]
    answers = {r["seq"]: r["content"] for r in rows if r["k"] == 4}
    asks = [a["seq"] for a in actions if a["session_id"] is None and a["record_type"] == "summary_check"]
    assert asks and sum(r["k"] == 4 and r["seq"] in asks for r in rows) == len(asks)
    assert all(answers[q] == answered({"success": True, "summary": None}) for q in asks)
    sample = [r for r in export.chat_samples(frame(spark, actions), "BASE").collect() if r["session_id"] is None]
    assert len(sample) == 1 and sample[0]["n"] == len(rows) + 2 == len(sample[0]["messages"])


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_carried_against_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), i, rng.choice([None, None, i])) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at int, v int")
    got = ordered.carried(df, ["key"], ["at"], parts, old=("before", F.col("v")), new=("after", F.col("v")), n=("total", F.lit(1)), s=("total", F.col("v"))).collect()
    assert len(got) == len(rows)
    for r in got:
        own = sorted((x for x in rows if x[0] == r["key"]), key=lambda x: x[1])
        before, after = [x[2] for x in own if x[1] < r["at"]], [x[2] for x in own if x[1] > r["at"]]
        known = [v for v in before if v is not None]
        assert r["old"] == (known or [None])[-1] and r["new"] == ([v for v in after if v is not None] or [None])[0]
        assert r["n"] == len(before) and r["s"] == sum(known)
    assert ordered.carried(df.limit(0), ["key"], ["at"], parts, n=("total", F.lit(1))).collect() == []


def qa_machine(actions):
    out, last, answers, results = [], None, [], set()
    for a in (a for a in actions if a["record_type"] != "document_preview"):
        pivot = a["record_type"] == "pivot" or a["intent"] == "pivot_query"
        skip = not pivot and a["intent"] == "smart_skip"
        asked = a["failed_query"] if pivot else a["search_query"]
        found = (a["failed_context"] if pivot else [a["skipped_chunk"]] if skip and a["skipped_chunk"] else [] if skip else a["search_context"]) or []
        if asked and asked != last:
            out += [{"role": "assistant", "reasoning": "", "calls": [("search_document", arguments(a, asked))]}, {"role": "tool", "content": searched(asked, found)}]
            last = asked
        if pivot or skip:
            continue
        if a["record_type"] == "calculation":
            results.add(a["action_id"])
        elif a["record_type"] in ("flow", "scope", "parameter"):
            amount, name = f"{'' if a['value'] is None else a['value']} {a['unit'] or ''}", a["name"].lower()
            if a["record_type"] == "scope":
                answers.append(f"The functional unit is: {a['description'] or a['parameter_name']}")
            elif a["record_type"] == "parameter":
                answers.append(f"The power is {amount}.")
            elif a["link_to"] in results:
                answers.append(f"Based on the calculation, the {name} is {amount}.")
            elif a["flow_type"] == "Input":
                answers.append(f"The process consumed {amount} of {name}.")
            elif a["flow_type"] == "Output":
                said = {"Product": "The process produced {} of {}.", "Waste": "The process generated {} of {} waste.", "Emission": "The process emitted {} of {}."}
                answers.append(said.get(a["category"], "The output is {} of {}.").format(amount, name))
            else:
                answers.append(f"The {name} is {amount}.")
    return out + ([{"role": "assistant", "reasoning": "", "content": " ".join(answers)}] if answers else [])


def test_qa_samples_against_the_machine(spark):
    actions = log(5)
    for r in export.qa_samples(frame(spark, actions), "BASE", 4).collect():
        own = [a for a in actions if a["session_id"] == r["session_id"]]
        assert [plain(m) for m in r["messages"]][2:] == qa_machine(own)
        prompt = r["messages"][0]["content"]
        assert prompt == "BASE" or prompt.endswith(export.QA_INJECTION) and "y" * 501 not in prompt


def test_system_prompts(spark):
    rows = [dict.fromkeys(log(1)[0]) | x for x in (
        dict(session_id="0123456789", seq=1, record_type="flow"), dict(session_id="0123456789", seq=3, record_type="document_preview", document_name="later"),
        dict(session_id="0123456789", seq=2, record_type="document_preview", document_name="A.pdf", document_preview={"chunk_0": {"chunk_id": "0", "content": "z" * 700}, "chunk_1": {"chunk_id": "1", "content": ""}}),
        dict(session_id="none", seq=1, record_type="flow"), dict(session_id="bare", seq=1, record_type="document_preview"),
    )]
    head = '\n\n**DOCUMENT CONTEXT**: \nA PDF document has been uploaded and is ready for analysis.\n- Document Name: "{}"\n- Document ID: {}...\n'
    whole = {r["session_id"]: r["prompt"] for r in export.system_prompts(frame(spark, rows), "B").collect()}
    shown = '\n**CHUNK 0 PREVIEW** (Executive Summary / Introduction):\n"{}"\n'
    assert whole == {"none": "B", "bare": "B" + head.format("Unknown Document", "bare") + export.INJECTION, "0123456789": "B" + head.format("A.pdf", "01234567") + shown.format("z" * 700) + export.INJECTION}
    cut = {r["session_id"]: r["prompt"] for r in export.system_prompts(frame(spark, rows), "B", most=500).collect()}
    assert cut["0123456789"] == "B" + head.format("A.pdf", "01234567") + shown.format("z" * 500 + "...") + export.INJECTION


def test_samples_are_valid_training_data(spark):
    """What the validation finds in exported samples is reasoning that is still to be written, and nothing of their form."""
    rows = export.chat_rows(frame(spark, log(9)), 4)
    calls = F.when(F.col("tool_calls").isNotNull(), F.concat(F.lit("["), F.array_join("tool_calls", ","), F.lit("]")))
    samples = rows.select(F.col("session_id").alias("sample"), (F.col("seq") * 10 + F.col("k") + 1).alias("place"), "role", "content", F.col("reasoning_content").alias("reasoning"), calls.alias("tool_calls"))
    faults = {r["issue"] for r in chat.validate(samples).collect()}
    assert faults <= {"missing_reasoning", "missing_content", "placeholder_not_replaced", "empty_tool_calls"}


@pytest.mark.parametrize("category, query", [("Gas", "gas argon nitrogen shielding"), ("Emission", "emissions CO2 exhaust gas"), ("Transport Service", "transport shipping logistics"), ("gas", None), (None, None)])
def test_category_queries(spark, category, query):
    assert spark.createDataFrame([(category,)], "c string").select(export.category_query(F.col("c")).alias("q")).first()["q"] == query
