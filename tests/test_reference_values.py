"""Golden values of rules that have fixed values, and of sources that no query reads."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import action_log, chat, chunking, evaluation, export, prompts, retrieval, text_features, tools
from millrace.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, found",
    [
        ("The Global Warming Potential and CED", ["GWP", "CED"]), ("eutrophication potential", ["EP"]), ("能源消耗", ["CED", "能耗"]), ("碳排放; CO2 的排放", ["碳足迹"]),
        ("Life Cycle", ["生命周期"]), ("POCP", ["POCP"]), ("温室气体", ["GWP"]), ("steel", []), ("a paper", ["AP"]), ("", []),
    ],
)
def test_indicators(spark, text, found):
    assert one(spark, text_features.indicators(F.lit(text))) == found


def test_numeric_facts():
    found = text_features.facts("It took 5.5 kWh/kg, 12% and 3 hours at 20 °C.")
    assert [(f["value"], f["unit"]) for f in found] == [(5.5, "kWh/kg"), (20.0, "°C"), (5.5, "kWh"), (12.0, "%"), (3.0, "hour")]
    assert found[0]["formatted"] == "5.5 kWh/kg" and found[0]["start"] == 8 and found[0]["context"].startswith("It took 5.5 kWh/kg, 12%")


@pytest.mark.parametrize(
    "line, kept",
    [
        ("A title that is long enough:", True), ("A title that is long enough?", True), ("Not a title but a long sentence.", False), ("A clause of some length, with a comma,", False),
        ("Page 3 of the whole long report", False), ("by: somebody with a long name", False), ("Abstract", False), ("Abstract of a long enough paper", True), ("x" * 251, False), ("short", False),
    ],
)
def test_titles(spark, line, kept):
    got = one(spark, text_features.title(F.lit("\n  \n " + line + " \nmore")))
    assert got == (line if kept else None)


def test_materials_span_lines(spark):
    assert one(spark, text_features.materials(F.lit("Stainless\nsteel and natural\tgas"))) == ["stainless\nsteel", "natural\tgas"]


def test_query_keywords(spark):
    assert one(spark, retrieval.keywords(F.lit("The 的 of 能耗 x the"))) == ["The", "of", "能耗", "the"]


def test_key_information(spark):
    text = F.lit("Energy is used. Not split here。Second energy！third；Energy four\nlast energy")
    assert one(spark, retrieval.key_information(text, F.lit("energy"))) == "Energy is used. Not split here Second energy Energy four"
    assert one(spark, retrieval.key_information(F.lit("a" * 101), F.lit("none here"))) == "a" * 100 + "..."
    assert one(spark, retrieval.key_information(F.lit("abc"), F.lit("none here"))) == "abc"


def test_key_points(spark):
    text = "intro\n- first\n • second\n3) third\nOur approach works. End"
    got = one(spark, retrieval.key_points(F.lit(text), F.lit("x")))
    assert got["content"] == "• first\n• second\n• third" and got["confidence"] == pytest.approx(0.7)
    words = one(spark, retrieval.key_points(F.lit("nothing here. but energy there."), F.lit("energy")))
    assert words["content"] == "• but energy there"
    assert one(spark, retrieval.key_points(F.lit("Plain words stand alone here"), F.lit("zzz")))["confidence"] == pytest.approx(0.2)


def test_key_points_read_a_text_once(spark):
    """A long text without a sentence's end, and many blank lines, take no longer than others of their length."""
    text = "words without an end " * 20_000 + "\n" * 200_000
    start = time.monotonic()
    got = one(spark, retrieval.key_points(F.lit(text), F.lit("end")))
    assert got["content"].startswith("• words without") and time.monotonic() - start < 30
    late = "no point. The First process, the last Method! results follow"
    assert one(spark, retrieval.key_points(F.lit(late), F.lit("x")))["content"] == "• The First process, the last Method!"


def test_extracted_modes(spark):
    hits = spark.createDataFrame([("It used much energy. - Not that one here.", 0.5)], "content string, similarity double")
    assert retrieval.extracted(hits, "energy").first()["extract_type"] == "chunk"
    assert retrieval.extracted(hits, "energy", "sentences").first()["extracted_content"] == "It used much energy"
    assert retrieval.extracted(hits, "energy", "key_points").first()["extract_type"] == "key_points"


@pytest.mark.parametrize(
    "text, n, examples",
    [
        ("| Mass | 5 | kg |\n| Flow | 7.5 | L/min |", 1, ["5", "(L/min)"]), ("| A | 5 | kg |\n| B | 6 | kWh |", 2, ["5", "6", "(kg, kWh)"]), ("## Table 3", 0, []),
        ("see page 12", 0, []), ("1.5 without pipes kg", 0, []), ("| 5 | kg | kg | kg | kg |", 0, ["5"]), ("| Unit | 4 | g |", 1, ["4", "(t, g)"]), ("", 0, []),
    ],
)
def test_table_patterns(text, n, examples):
    assert text_features.table_patterns(" ".join(text.split())) == (n, examples)


def test_features_by_kind(spark):
    rows = spark.createDataFrame([("| A | 5 | kg |\n| B | 6 | kWh |", "table_section"), ("5 kg and 6 kWh per batch", "text"), ("5 kg", None), (None, "text")], "text string, chunk_type string")
    got = {(r["text"], r["chunk_type"]): r["features"] for r in text_features.chunk_features(rows).collect()}
    assert len(got) == 4 and got[(rows.first()["text"], "table_section")]["is_table"] and got[(rows.first()["text"], "table_section")]["pattern_count"] == 2
    text = got[("5 kg and 6 kWh per batch", "text")]
    assert (text["pattern_count"], text["basis"], text["warnings"], text["is_table"]) == (2, True, [], False)
    assert got[(None, "text")]["warnings"] == ["Low quantitative evidence, consider Pivot"]


def test_cells_by_kind(spark):
    cells = spark.createDataFrame([("t", 1, 0, "能耗", "5 MJ then 6.5 kWh/kg"), ("t", 1, 1, "Name", "steel"), ("t", 2, 0, "能耗", "")], "table_id string, row int, col int, header string, value string")
    got = sorted((r["kind"], r["number"], r["unit"], r["formatted"]) for r in text_features.classified(cells).collect())
    assert got == [("energy_consumption", 6.5, "kwh/kg", "6.5 kwh/kg"), ("material_flows", 6.5, "kwh/kg", "6.5 kwh/kg")]
    assert text_features.table_summary(cells).first()["summary"] == "表格包含2行2列数据 | LCA数据: 能源消耗: 1项, 材料流: 1项"


def test_tables_in_text(spark):
    made = one(spark, text_features.text_to_markdown(F.lit("Table 2 of it\nEnergy: 5 kWh\n\nplain words")))
    assert made == "## Table 2 of it\n\n| Parameter | Value | Unit | Description |\n|-----------|-------|------|-------------|\n| Energy | 5 kWh | | |\n| plain words | | | |\n"
    assert one(spark, text_features.text_to_markdown(F.lit(" a | b \n c "))) == "## Table (Detected)\n\na | b\nc"
    html = one(spark, text_features.pipes_to_html(F.lit("x\n| A | B |\n|---|---|\n| 1 | 2 |\n| 3 |")))
    assert html == "<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"
    assert one(spark, text_features.pipes_to_html(F.lit("| A | B |"))) == "| A | B |"


def test_catalog_hits(spark):
    rows = [(f"u{i:02}", name, [cat], prod) for i, (name, cat, prod) in enumerate([("steel pipe", "x", "y")] * 7 + [("iron", "Steel goods", "y")] * 5 + [("iron", "x", "of STEEL")] * 5 + [("steel", "x", "y")])]
    got = retrieval.catalog_keyword_hits(spark.createDataFrame(rows, "uuid string, name string, categories array<string>, reference_product string"), "Steel").collect()
    assert [(r["uuid"], r["found_in"]) for r in got] == [("u17", "text"), *((f"u0{i}", "text") for i in range(4)), ("u07", "category"), ("u08", "category"), ("u09", "category"), ("u12", "product"), ("u13", "product")]


@pytest.mark.parametrize(
    "code, safe",
    [
        ("import math\nfrom json import loads", True), ("import os.path", False), ("x = Eval(1)", False), ("from sys import argv", False), ("  import bw2data as b", True), ("import math, json", False),
        ("important = 1", True), ("a\nrm -rf", False), ("model", True), ("import ", True), (None, False),
    ],
)
def test_code(spark, code, safe):
    assert one(spark, chat.safe_code(F.lit(code).cast("string"))) is safe


@pytest.mark.parametrize("text, leaks", [("a |\n| b", True), ("a |\\n| b", True), ('"session_id" and "timestamp"', True), ('"session_id"', False), ('"' * 51, True), ('"' * 50, False)])
def test_leaks(spark, text, leaks):
    assert one(spark, chat.leaks_json(F.lit(text))) is leaks and (one(spark, chat.without_leaks(F.lit(text))) == text) is not leaks


def test_files(spark):
    rows = [("a", "[]"), ("b", '{"messages": []}'), ("c", '{"x": 1}'), ("d", "{"), ("e", "7")]
    got = chat.validate_files(spark.createDataFrame(rows, "file string, content string")).collect()
    assert {(r["file"], r["issue"]) for r in got} == {("c", "format_error"), ("d", "json_error"), ("e", "format_error")}


def test_long_chains(spark):
    rows = [("S1", f"A{i}", f"A{i - 1}" if i else None) for i in range(61)] + [("S2", "A1", "A0"), ("S3", "R1", "R2"), ("S3", "R2", "R1"), ("S4", "A0", "")]
    got = {(r["session_id"], r["action_id"]): (r["root"], r["depth"]) for r in action_log.chains(spark.createDataFrame(rows, "session_id string, action_id string, link_to string")).collect()}
    assert all(got[("S1", f"A{i}")] == ("A0", i) for i in range(61)) and got[("S2", "A1")] == ("A0", 1) and got[("S4", "A0")] == ("A0", 0) and len(got) == len(rows)


@pytest.mark.parametrize(
    "request_, scenario",
    [
        (dict(intent="refine_same", tool="record_parameter"), "refine_same_chunk"), (dict(intent="pivot_query"), "pivot_query_no_results"), (dict(intent="pivot_query", ambiguous=True), "record_parameter_ambiguous"),
        (dict(tool="record_parameter", uncertain=True, ambiguous=True), "record_parameter_uncertain"), (dict(tool="record_parameter", inference_required=True), "record_parameter_with_inference"),
        (dict(tool="record_parameter"), "record_parameter_direct"), (dict(tool="record_process_flow", scope_unclear=True, flow_type="Input"), "record_flow_uncertain"),
        (dict(tool="record_process_flow", last_intent="calculate"), "record_flow_from_calculation"), (dict(tool="record_process_flow", inference_required=True, flow_type="Output"), "record_flow_output_with_inference"),
        (dict(tool="record_process_flow", inference_required=True), "record_parameter_with_inference"), (dict(tool="record_process_flow", flow_type="Input"), "record_flow_input"),
        (dict(tool="record_process_flow"), "record_flow_uncertain"), (dict(tool="record_calculation"), None),
    ],
)
def test_scenarios(spark, request_, scenario):
    names = dict(intent="string", tool="string", last_intent="string", flow_type="string", uncertain="boolean", ambiguous="boolean", scope_unclear="boolean", from_calculation="boolean", inference_required="boolean")
    row = spark.createDataFrame([tuple(request_.get(k) for k in names)], ", ".join(f"{k} {v}" for k, v in names.items()))
    assert row.select(action_log.scenario().alias("s")).first()["s"] == scenario


def test_sources(spark, tmp_path):
    (tmp_path / "t" / "deep").mkdir(parents=True)
    for name in ("a.txt", "token_mapping.txt", "run_log.txt", "deep/b.txt"):
        (tmp_path / "t" / name).write_text(f"text of\n{name}")
    assert sorted(map(tuple, tables.read_texts(spark, str(tmp_path / "t")).collect())) == [("a.txt", "text of\na.txt"), ("b.txt", "text of\ndeep/b.txt")]
    rows = spark.createDataFrame([([("p1", "data"), ("p2", None)],)], "papers array<struct<title:string,lci_data:string>>")
    assert [tuple(r) for r in tables.papers(rows).collect()] == [("p1", "data")]
    tables.write_json_lists(spark.range(95).withColumn("x", F.lit("same")), str(tmp_path / "lists"), per_file=10)
    assert tables.read_json_list(spark, str(tmp_path / "lists"), "id long").agg(F.count("*"), F.sum("id")).first()[:] == (95, 95 * 47)
    assert len([p for p in (tmp_path / "lists").iterdir() if p.name.startswith("file=")]) > 5


def test_search_arguments(spark):
    assert one(spark, export.search_arguments(F.lit("s"), F.array(F.lit("a")))) == '{"session_id":"s","query":"a"}'
    assert one(spark, export.search_arguments(F.lit("s"), F.array(F.lit("a"), F.lit("b")))) == '{"session_id":"s","queries":["a","b"]}'


@pytest.mark.parametrize(
    "tool, content, said",
    [
        ("search_document", '{"results": [{"chunk_id": "c", "content": "x"}]}', "Found 1 chunks:\n  - Chunk c: x"), ("search_document", "{}", "No results found"),
        ("record_process_flow", '{"data": {"action_id": "ACT_0001"}}', "Flow recorded successfully, action_id: ACT_0001"), ("get_session_summary", '{"completeness_score": 40}', "Completeness: 40%, Missing: []"),
        ("other", '{"a": 1}', '{"a": 1}'), ("search_document", "x" * 600, "x" * 500),
    ],
)
def test_response_summaries(spark, tool, content, said):
    assert one(spark, prompts.response_summary(F.lit(tool), F.lit(content))) == said


@pytest.mark.parametrize(
    "call, said",
    [
        ('{"name": "search_document", "arguments": {"queries": ["a", "b"]}}', "Search the document for: a, b"), ('{"name": "execute_calculation", "arguments": {"formula": "1 + 1"}}', "Execute calculation: 1 + 1"),
        ('{"name": "record_process_flow", "arguments": {"flow_type": "Input", "category": "Gas", "name": "argon", "value": 2.5, "unit": "kg"}}', "Record Input flow - Gas: argon (2.5 kg)"),
        ('{"name": "get_session_summary"}', "Check the session summary to assess extraction progress"), ('{"name": "build"}', "Call tool: build"),
    ],
)
def test_next_actions(spark, call, said):
    assert one(spark, prompts.next_action(F.lit(call))) == said


@pytest.mark.parametrize(
    "predicted, true, score",
    [
        ("steel sheet plate powder", "steel sheet plate", 1.0), ("Steel!", "steel", 1.0), ("steel", "stainless steel, 316L", 1.0), ("argon gas", "gas mix argon", 0.5), ("water cooling", "cooling steam", 0.5),
        ("copper", "nickel", 0.0), (None, "nickel", 1.0), ("a b c d", "d x y z", 0.0),
    ],
)
def test_name_scores(spark, predicted, true, score):
    df = spark.createDataFrame([(predicted, true)], "p string, t string")
    assert df.select(evaluation.name_score(F.col("p"), F.col("t")).alias("s")).first()["s"] == score


def test_field_scores(spark):
    rows = spark.createDataFrame([("steel", "Raw Material", "KG", "steel", "raw material", "kg"), ("iron", "Gas", "g", "steel", "Gas", "kg"), ("argon gas", "x", "g", "gas mix argon", None, "kg")], "pn string, pc string, pu string, tn string, tc string, tu string")
    field = lambda side: {"name": F.col(f"{side}n"), "category": F.col(f"{side}c"), "unit": F.col(f"{side}u")}.get
    assert [round(r["s"], 6) for r in rows.select(evaluation.field_score(field("p"), field("t")).alias("s")).collect()] == [1.0, 0.333333, 0.166667]


@pytest.mark.parametrize(
    "name, note, hint",
    [
        ("316L powder", None, "316L stainless steel"), ("Stainless Steel sheet", "", "stainless steel"), ("X2CrNiMo17", None, "stainless steel"), ("steel", "as powder", "steel powder"), ("steel", None, None),
        ("Ti6Al4V", None, "titanium alloy"), ("bar", "Titanium", "titanium alloy"), ("wire", "Ti-6Al-4V", "titanium alloy"), ("Aluminium", None, "aluminum"), ("steel powder", "aluminum", "steel powder"), (None, None, None),
    ],
)
def test_material_hints(spark, name, note, hint):
    assert spark.createDataFrame([(name, note)], "n string, t string").select(prompts.material_hint(F.col("n"), F.col("t")).alias("h")).first()["h"] == hint


def test_material_hints_of_sessions(spark):
    rows = [(1, "Raw Material", "316L", None), (1, "Process Material", "titanium", None), (1, "Raw Material", "316L rod", None), (1, "Gas", "aluminum", None), (2, "Raw Material", "wood", None), (3, "Waste", "steel powder", None)]
    got = prompts.material_hints(spark.createDataFrame(rows, "session_id long, category string, name string, note string")).collect()
    assert {r["session_id"]: r["hints"] for r in got} == {1: ["316L stainless steel", "titanium alloy"], 2: []}


@pytest.mark.parametrize(
    "reply, name",
    [
        ('<think>a</think> "Steel scrap" ', "Steel scrap"), ("'steel scrap'", "steel scrap"), ("<think>a</think>first<think>b</think>\n last", "last"), ("plain", "plain"), ("", "old"), (None, "old"),
        ("x" * 100, "old"), ("x" * 99, "x" * 99), ("<think>never closed", "<think>never closed"), ("\"'both'\"", "both"), ("<think>a</think> ", "old"),
    ],
)
def test_rewritten_names(spark, reply, name):
    assert spark.createDataFrame([(reply,)], "r string").select(prompts.rewritten(F.col("r"), F.lit("old")).alias("n")).first()["n"] == name


def test_document_lines(spark):
    flows = spark.createDataFrame(
        [
            (1, 1, "Input", "Gas", "argon", "2", "kg", 5, None), (1, 2, "Input", "Energy", "power", "7", "kWh", None, [("time", "2", "h"), ("load", "3", "kW")]), (1, 3, "Input", "Energy", "heat", "9", "MJ", None, None),
            (1, 1, "Output", "Product", "part", "1", "kg", 4, None), (1, 2, "Output", "Waste", "scrap", "3", "kg", 2, [("mass", "3", "kg")]), (1, 3, "Output", "Gas", "argon", "1", "kg", None, None),
        ],
        "session_id long, seq long, side string, category string, name string, value string, unit string, quantity int, child_nodes array<struct<name:string,value:string,unit:string>>",
    )
    parameters = spark.createDataFrame([(1, 2, "speed", "8", "mm/s"), (1, 1, "layer", "30", "um")], "session_id long, seq long, name string, value string, unit string")
    relations = spark.createDataFrame([(1, 1, "Gas: argon", "old", ["x"]), (1, 2, "Gas: argon", "flow x time", ["flow", "time"]), (1, 3, "Energy: heat", None, None), (2, 1, "Waste: scrap", "none", [])], "session_id long, seq long, flow string, calculation string, parameters_used array<string>")
    told = lambda level: [r["line"] for r in prompts.document_lines(flows, parameters, relations, level).orderBy("part", "seq", "k").collect()]
    assert told("simple") == [
        "[CALCULABLE] argon (Gas): 2 kg", "[CALCULABLE] power (Energy): parameters are time: 2 h, load: 3 kW, final value is 7 kWh", "[CALCULABLE] heat (Energy): 9 MJ", "[DIRECT] part (Product): 1 kg, 4 units",
        "[CALCULABLE] scrap (Waste): parameters are mass: 3 kg, final value is 3 kg, 2 units", "[CALCULABLE] argon (Gas): 1 kg", "[CONTEXT] layer: 30 um", "[CONTEXT] speed: 8 mm/s",
    ]
    assert [x for x in told("complex") if x.startswith("  ")] == ["  → Calculation: flow x time", "  → Uses parameters: flow, time", "  → Calculation: ", "  → Uses parameters: ", "  → Calculation: flow x time", "  → Uses parameters: flow, time"]
    names = spark.createDataFrame([(1, None), (2, "SLM"), (3, "none")], "session_id long, process_name string")
    asked = {r["session_id"]: r["prompt"] for r in prompts.document_prompts(names, flows, parameters, relations, "medium", "energy_audit").collect()}
    assert asked[1].startswith("Process: AM Process\n\nData to document:\n- [CALCULABLE] argon (Gas): 2 kg\n- ") and "\n\n**Tip for Medium documents**:\n- You may" in asked[1]
    assert "\n\nNote: \n- [DIRECT] = state the final value directly\n- [CALCULABLE]" in asked[2] and asked[2].startswith("Process: SLM\n\nData to document:\n\n\nNote: ") and "Tip" not in asked[3]
    assert asked[3].endswith("\n\nWrite a formal energy audit using tables and narrative paragraphs. Start with a clear document title using # heading. Use proper Markdown formatting (headings, bold text, tables, horizontal rules). Return only the Markdown document.\n")


@pytest.mark.parametrize("tool, given, missing", [("search_document", [], []), ("execute_calculation", None, ["expression"]), ("define_lca_scope", ["description"], ["parameter_name"]), ("build_lca_system", ["x"], ["system_description", "functional_unit"]), ("none", [], []), (None, None, [])])
def test_missing_arguments(spark, tool, given, missing):
    assert tools.missing(spark.createDataFrame([(tool, given)], "tool string, given array<string>")).first()["missing"] == missing


def test_shared_folder_needs_a_local_master():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        tables.shared_folder(Session)


def _calls(monkeypatch, name):
    """The texts that a function of text features is called with."""
    seen, real = [], getattr(text_features, name)
    monkeypatch.setattr(text_features, name, lambda t: seen.append(t) or real(t))
    return seen


def test_equal_texts_of_a_batch_are_read_once(monkeypatch):
    texts = pd.Series(["5 kg of steel", None, "5 kg of steel", "", "7 MJ"])
    seen = _calls(monkeypatch, "facts")
    assert [len(x) for x in text_features._numeric_facts(texts)] == [2, 0, 2, 0, 2] and sorted(seen) == ["", "5 kg of steel", "7 MJ"]
    seen = _calls(monkeypatch, "table_patterns")
    assert list(text_features._table_patterns(texts)["n"]) == [1, 0, 1, 0, 1] and len(seen) == 3


@pytest.mark.parametrize("column", [lambda t: text_features.decision_features(t), lambda t: text_features.enhanced_query(F.lit("a"), F.lit("b"), t), lambda t: text_features.indicators(t)])
def test_texts_are_read_once(spark, column):
    """The plan holds each expression over the text a few times, not once for each use of its result."""
    plan = spark.range(1).select(column(F.concat(F.lit("mark"), F.col("id").cast("string"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(mark") <= 14


def test_table_summary_without_joins(spark):
    tables = spark.createDataFrame([("t", "| Material | Mass (kg) |\n|---|---|\n| steel | 3 |\n| | 5 kWh |"), ("none", "no table"), ("head", "| a | b |"), (None, "| a |\n| b |")], "table_id string, text string")
    made = text_features.table_summary(text_features.cells(tables))
    assert [tuple(r) for r in made.collect()] == [("t", "表格包含2行2列数据 | LCA数据: 能源消耗: 1项, 材料流: 3项")]
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_handed_on(spark, monkeypatch):
    """Chunks leave a task in frames bounded by their characters, not with a whole batch of texts."""
    sizes = []

    class Docs:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            frames = list(run(iter([pd.DataFrame({"doc_id": range(50), "text": ["word " * 20_000] * 49 + [None]})])))
            sizes.extend(f["content"].str.len().sum() for f in frames)
            return pd.concat(frames)

    got = chunking.split_documents(Docs())
    assert max(sizes) < 4_000_000 and len(sizes) > 2 and got["doc_id"].nunique() == 49
    assert list(got[got["doc_id"] == 48]["content"]) == chunking.split("word " * 20_000)
