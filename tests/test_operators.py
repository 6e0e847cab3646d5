"""Golden values and invariants of operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import units
from millrace.functions.calculator import evaluate
from millrace.operators import action_log, chat, layout, matching, retrieval, text_features
from millrace.operators.chunking import split
from millrace.streaming import sessions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_next_ids_from_10000_on(spark):
    ids = ["ACT_0001", "ACT_9999", "ACT_10000", "ACT_10001", "ACT_00007", "ACT_12", "ACT_x", None]
    actions = spark.createDataFrame([("S1", i) for i in ids] + [("S2", "ACT_9999"), ("S3", "ACT_0003")], "session_id string, action_id string")
    got = {r["session_id"]: (r["last_number"], r["n"], r["next_id"]) for r in action_log.next_ids(actions).collect()}
    assert got == {"S1": (10001, 4, "ACT_10002"), "S2": (9999, 1, "ACT_10000"), "S3": (3, 1, "ACT_0004")}


@pytest.mark.parametrize("a, b, expected", [("kg", "g", True), ("kWh", "MJ", True), ("kg", "m2", False), ("kg", "kBq", False), ("furlong", "furlong", True), ("furlong", "kg", False), (None, "", True)])
def test_compatible(spark, a, b, expected):
    assert one(spark, units.compatible(F.lit(a).cast("string"), F.lit(b))) is expected


def test_convert(spark):
    assert one(spark, units.convert(F.lit(67.47), F.lit("kWh"), F.lit("MJ"))) == pytest.approx(242.892)
    assert one(spark, units.convert(F.lit(4.11), F.lit("kg"), F.lit("g"))) == pytest.approx(4110)
    assert one(spark, units.convert(F.lit(1.0), F.lit("lb"), F.lit("kg"))) is None
    back = units.convert(units.convert(F.lit(3.5), F.lit("t"), F.lit("mg")), F.lit("mg"), F.lit("t"))
    assert one(spark, back) == pytest.approx(3.5)


@pytest.mark.parametrize("text, value", [("2 + 3 * 4", 14), ("-2 ** 2", -4), ("max(1, min(5, 3))", 3), ("log10(1000)", 3)])
def test_calculator(text, value):
    assert evaluate(text) == pytest.approx(value)


@pytest.mark.parametrize("text", ["", "1 / 0", "x", "__import__('os')", "(1).real", "'a' * 9", "9 ** 9 ** 9", "1e999", "[1]", "1 if 1 else 2", "True", "1" * 201, None])
def test_calculator_rejects(text):
    with pytest.raises(ValueError):
        evaluate(text)


def test_calculator_binds_names():
    assert evaluate("max(x, ma)", {"x": 2.0, "ma": 3.0}) == 3


@given(st.text(alphabet="ab \n.;。", max_size=400), st.integers(20, 60))
@settings(max_examples=60, deadline=None)
def test_chunks_hold_all_words(text, size):
    chunks = split(text, size, size // 4)
    assert all(len(c) <= size for c in chunks)
    assert set("".join(text.split())) <= set("".join(chunks))


def test_boosts_stay_in_range(spark):
    text = F.lit("| 1 | 2 | 3 | 4 | 5 | 2015 | powder")
    terms = retrieval.query_terms(F.lit("powder|steel powder"))
    assert one(spark, retrieval.coverage_boost(text, terms)) == pytest.approx(0.075)
    assert one(spark, retrieval.density_boost(text)) == pytest.approx(0.12)
    assert one(spark, retrieval.table_boost(text)) == pytest.approx(0.18)


def test_decision_features(spark):
    f = one(spark, text_features.decision_features(F.lit("It used 5,000 L of water and 800 kWh per tonne.")))
    assert (f["pattern_count"], f["examples"], f["basis"]) == (2, ["5,000 L", "800 kWh"], True)


def test_distance_similarity(spark):
    got = [one(spark, matching.similarity_of_distance(F.lit(d))) for d in (0.0, 1.0, 1.01, 3.0)]
    assert got == pytest.approx([0.0, 1.0, 1 / 2.01, 0.25])


def test_lines(spark):
    words = spark.createDataFrame([(1, 10.0, 5.0, "b"), (1, 9.0, 1.0, "a"), (1, 16.5, 0.0, "c"), (1, 30.0, 0.0, "d")], "page long, top double, x0 double, word string")
    assert [r["text"] for r in layout.lines(words).orderBy("line").collect()] == ["a b", "c", "d"]


def test_validation_names_each_fault(spark):
    one_call = '[{"name": "record_parameter", "arguments": {}}]'
    rows = [
        (0, "user", "", None, None), (1, "assistant", None, None, one_call), (2, "assistant", "", "r", None), (3, "assistant", "a", "Data was NOT FOUND", one_call),
        (4, "assistant", "a", "[SMART_SKIP_PLACEHOLDER_1]", "[]"), (5, "tool", "", None, None), (6, "user", None, None, None), (7, "assistant", None, "r", '[7, {"name": "x"}, {"arguments": "y"}]'),
        (8, "assistant", "all is well", None, None), (9, "system", "", None, None),
    ]
    found = chat.validate(spark.createDataFrame([(1, *r) for r in rows], "sample int, place int, role string, content string, reasoning string, tool_calls string"))
    assert {(r["place"], r["call"], r["issue"]) for r in found.collect()} == {
        (1, None, "missing_reasoning"), (2, None, "missing_content"), (3, None, "reasoning_action_mismatch"), (4, None, "placeholder_not_replaced"), (4, None, "empty_tool_calls"),
        (5, None, "empty_tool_response"), (6, None, "empty_user_content"), (7, 0, "invalid_tool_call"), (7, 1, "missing_tool_args"), (7, 2, "missing_tool_name"), (7, 2, "invalid_tool_args"),
    }


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = sessions.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r["day"], r["event_type"], r["n"])
    assert sorted(map(key, spark.table("daily").collect())) == sorted(map(key, sessions.windowed(events).collect()))
    numbered = sessions.sequenced(stream).writeStream.format("memory").queryName("numbers").trigger(availableNow=True).start()
    numbered.awaitTermination()
    assert sorted(map(tuple, spark.table("numbers").collect())) == sorted(map(tuple, sessions.numbered(events).collect()))


def test_first_calls(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id", "event_type", "event_id")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = sessions.first_calls(stream).writeStream.format("memory").queryName("first_calls").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r["user_id"], r["event_type"]) for r in spark.table("first_calls").collect()]
    assert len(got) == len(set(got)) and set(got) == {(r["user_id"], r["event_type"]) for r in events.collect()}


def test_touches(spark):
    rows = [(1, 1, "2024-01-01 00:00:00"), (1, 2, "2024-01-01 02:00:00"), (1, 3, "2024-01-01 04:00:01"), (1, 4, "2024-01-03 04:00:02"), (2, 5, "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r["event_id"]: (r["idle_seconds"], r["alive"]) for r in sessions.touched(events).collect()}
    assert got == {1: (None, False), 2: (7200, True), 3: (7201, False), 4: (172_801, False), 5: (None, False)}


def test_zipped_files_are_many_small_tasks(spark):
    """Files are paired by place; tasks follow from the number of rows, and the result from no number of tasks."""
    from millrace.operators import evaluation

    schema = "file string, place int, flow_name string, category string, unit string, value double, chunk_id string"
    predicted = spark.createDataFrame([("x", 2, "Gas!", "A", "kg", 9.0, "c1"), ("x", 1, "gas", None, "kg", 1.0, "c1"), ("y", 1, None, None, None, 1.0, None), ("z", 1, "b", None, None, None, None), (None, 1, "n", None, None, 1.0, None)], schema)
    true = spark.createDataFrame([("a", 1, "GAS", "A", "t", 1.0, "c1"), ("a", 2, "gas", "A", "t", 9.0, "c1"), ("b", 1, "", None, None, 0.0, None)], schema)
    got = [evaluation.zipped(predicted, true, task=n) for n in (1, 500_000)]
    assert [tuple(r) for g in got for r in g.collect()] == [(3, round((2 / 3 + 1) / 3, 6), 3, 1, 0.333333, 1, 1.0)] * 2
    plans = [g._jdf.queryExecution().executedPlan().toString() for g in got]
    assert ", 8), REPARTITION_BY_NUM" in plans[0] and ", 4), REPARTITION_BY_NUM" in plans[1]
