"""Matching of flows: strings, rules, units, contexts and nearest vectors against plain Python."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import matching, substrings, vectors
from millrace.plans import q_matching


def test_holders_against_plain_python(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc ü") for _ in range(n))
    names = [word(rng.randrange(0, 14)) for _ in range(300)] + ["", "a", "a.c", "(x", None, "aaaaaa"]
    needles = [word(rng.randrange(0, 7)) for _ in range(150)] + ["", "a", "zz", "zzzz", ".", "(x", None, "aaa", "aaaa"]
    got = substrings.holders(spark.createDataFrame([(n,) for n in needles * 2], "needle string"), spark.createDataFrame([(n,) for n in names * 2], "name string"))
    want = {(a, b) for a in needles for b in names if a and b and a in b}
    rows = list(map(tuple, got.collect()))
    assert len(rows) == len(set(rows)) and set(rows) == want
    for lists in (1, 5):
        again = substrings.holders(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(n,) for n in names], "name string"), lists)
        assert set(map(tuple, again.collect())) == want


def test_holders_compare_no_everything(spark):
    plan = substrings.holders(spark.range(5).select(F.lit("abcd").alias("needle")), spark.range(9).select(F.lit("xabcdx").alias("name")))
    told = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in told and "Cartesian" not in told


CATALOG = "uuid string, name string, flow_type string, categories array<string>"


@pytest.mark.parametrize(
    "category, fitting",
    [
        ("Raw Material", {"product", "elementary", "air", "energy name", "energy category", "power"}), ("Gas", {"product", "elementary", "air", "energy name", "energy category", "power"}),
        ("Cooling Media", {"product", "elementary", "air", "energy name", "energy category", "power"}), ("Process Energy", {"energy name", "energy category", "power"}),
        ("Post-processing Energy", {"energy name", "energy category", "power"}), ("Feedstock Energy", {"energy name", "energy category", "power"}), ("Emission", {"air"}),
        ("Waste", {"waste", "waste category"}),
        ("Product", None), ("Recovered Material", None), (None, None),
    ],
)
def test_rules(spark, category, fitting):
    rows = [
        ("product", "steel", "PRODUCT_FLOW", ["Metals"]), ("elementary", "iron", "ELEMENTARY_FLOW", ["Resource"]), ("air", "dioxide", "ELEMENTARY_FLOW", ["x", "Emission to air"]),
        ("waste", "scrap", "WASTE_FLOW", ["Metals"]), ("waste category", "slag", None, ["Municipal WASTE treatment"]), ("energy name", "Electricity, low voltage", "PRODUCT_FLOW", None),
        ("energy category", "heat", "PRODUCT_FLOW", ["Energy carriers and technologies"]), ("power", "steam POWERED", "PRODUCT_FLOW", []), ("none", None, None, None), ("soiled", "mud", "PRODUCT_FLOW", ["Emission to soil"]),
    ]
    df = spark.createDataFrame(rows, CATALOG).withColumn("fits", matching.rules(F.col("name"), F.col("flow_type"), F.col("categories")))
    wanted = spark.createDataFrame([(category,)], "c string").select(matching.rule_of(F.col("c")).alias("r")).first()["r"]
    got = {r["uuid"] for r in df.collect() if wanted in r["fits"]}
    everything = {r[0] for r in rows}
    assert got == (everything if fitting is None else fitting | ({"soiled"} if wanted == "material" else set()))


def test_keywords(spark):
    said = spark.createDataFrame([(" Hot  ROLLED of steel coil",), ("a bc def",), ("",), (None,)], "n string").select(matching.keywords(F.col("n")).alias("k"), matching.needles(F.col("n")).alias("m")).collect()
    assert [r["k"] for r in said] == [["hot", "rolled"], ["def"], [], None]
    assert said[1]["m"] == ["a bc def", "def"]


def brute_candidates(flows, catalog, least=10, most=100):
    """By every query and every flow."""
    rule_flows = {
        "Raw Material": lambda n, t, c: t in ("PRODUCT_FLOW", "ELEMENTARY_FLOW"), "Waste": lambda n, t, c: t == "WASTE_FLOW" or any("waste" in x.lower() for x in c),
        "Process Energy": lambda n, t, c: any(w in n.lower() for w in ("electricity", "energy", "power")) or "Energy carriers and technologies" in c,
        "Emission": lambda n, t, c: t == "ELEMENTARY_FLOW" and bool({"Emission to air", "Emission to water", "Emission to soil"} & set(c)),
    }
    out = set()
    for q, name, category in flows:
        if not (name or "").strip():
            continue
        asked = [name.lower(), *[w for w in name.lower().split()[:3] if len(w) > 2]]
        fits = rule_flows.get(category, lambda *_: True)
        held = sorted((len(n), n.lower(), u, fits(n, t, c)) for u, n, t, c in catalog if n and any(a in n.lower() for a in asked))
        own = [h for h in held if h[3]][:most]
        out |= {(q, u, f, k + 1) for k, (_, _, u, f) in enumerate(own if len(own) >= least else held[:most])}
    return out


def test_candidates_against_plain_python(spark):
    rng = random.Random(2)
    parts = ["steel", "Steel wire", "welding wires", "weld", "iron", "Electricity", "of", "plate", "powder", "x", "scrap (mixed)", "a.b"]
    kinds = ["Metals", "Emission to air", "Waste treatment", "Energy carriers and technologies"]
    catalog = [(f"u{i:03}", " ".join(rng.sample(parts, rng.randrange(1, 4))), rng.choice(["PRODUCT_FLOW", "ELEMENTARY_FLOW", "WASTE_FLOW"]), rng.sample(kinds, 1)) for i in range(600)] + [("none", None, "PRODUCT_FLOW", [])]
    flows = [(i, " ".join(rng.sample(parts, rng.randrange(1, 5)))[rng.randrange(3) :], rng.choice(["Raw Material", "Waste", "Process Energy", "Emission", "Product", None])) for i in range(60)]
    flows += [(90, "weld wire", "Raw Material"), (91, None, "Waste"), (92, "  ", "Waste"), (93, "a.b", "Raw Material"), (94, "(m", "Waste"), (95, "no such name", "Waste")]
    got = matching.candidates(spark.createDataFrame(flows, "query_id long, name string, category string"), spark.createDataFrame(catalog, CATALOG)).collect()
    rows = {tuple(r) for r in got}
    assert len(rows) == len(got) and rows == brute_candidates(flows, catalog)
    names = {u: n for u, n, *_ in catalog}
    assert any("welding wires" in names[u] for q, u, *_ in rows if q == 90)


def test_candidates_are_bounded(spark):
    catalog = spark.range(500).select(F.format_string("u%03d", "id").alias("uuid"), F.lit("old steel").alias("name"), F.when(F.col("id") % 50 == 0, "WASTE_FLOW").otherwise("PRODUCT_FLOW").alias("flow_type"), F.array(F.lit("x")).alias("categories"))
    flows = spark.createDataFrame([(1, "old steel pipe", "Product"), (2, "steel", "Emission"), (3, "steel", "Waste")], "query_id long, name string, category string")
    rows = matching.candidates(flows, catalog).collect()
    of = {q: sorted(r["uuid"] for r in rows if r["query_id"] == q) for q in (1, 2, 3)}
    assert of[1] == [f"u{i:03}" for i in range(100)] == of[2] and of[3] == [f"u{i:03}" for i in range(0, 500, 50)]
    assert all(r["fits"] for r in rows if r["query_id"] == 3) and {r["rank"] for r in rows if r["query_id"] == 1} == set(range(1, 101))


MATCHED = CATALOG + ", unit string, v array<double>, text string"
ASKED = "query_id long, name string, category string, unit string, q array<double>, query string"


def test_matching_stages(spark):
    catalog = spark.createDataFrame(
        [("u1", "Steel plate", "PRODUCT_FLOW", ["metal"], "kg", [1.0, 0.0], "t"), ("u2", "steel rod", "PRODUCT_FLOW", ["metal"], "MJ", [0.9, 0.1], "t"), ("u3", "steel wire", "WASTE_FLOW", ["waste"], "kg", [0.0, 1.0], "t")], MATCHED
    )
    flows = spark.createDataFrame(
        [(1, "STEEL PLATE", "Raw Material", "MJ", [0.0, 1.0], "x"), (2, "steel sheet", "Raw Material", "kg", [1.0, 0.0], "x"), (3, "copper", "Gas", "kg", [1.0, 0.0], "x"), (4, "steel bar", None, None, [0.0, 1.0], "x")], ASKED
    )
    got = {(r["query_id"], r["uuid"]): (r["rank"], r["similarity"], r["compatible"]) for r in matching.match_flows(flows, catalog, dims=2).collect()}
    assert {k: v for k, v in got.items() if k[0] < 4} == {(1, "u1"): (1, 1.0, False), (2, "u1"): (1, 1.0, True), (2, "u3"): (2, 0.0, True)}
    assert [u for (q, u), v in sorted(got.items(), key=lambda x: x[1][0]) if q == 4] == ["u3", "u2", "u1"]  # no unit asked, nothing filtered


def test_units_before_the_cut(spark):
    """A compatible sixth candidate is found behind five that are not."""
    near = [(f"u{i}", f"steel {i}", "PRODUCT_FLOW", ["metal"], "MJ", [1.0, i / 100], "t") for i in range(5)]
    catalog = spark.createDataFrame([*near, ("u5", "steel 5", "PRODUCT_FLOW", ["metal"], "t", [0.0, 1.0], "t")], MATCHED)
    flows = spark.createDataFrame([(1, "steel", "Raw Material", "kg", [1.0, 0.0], "x"), (2, "steel", "Raw Material", "m2", [1.0, 0.0], "x")], ASKED)
    got = {q: [r["uuid"] for r in matching.match_flows(flows, catalog, dims=2).orderBy("rank").collect() if r["query_id"] == q] for q in (1, 2)}
    assert got == {1: ["u5"], 2: ["u0", "u1", "u2", "u3", "u4"]}


def test_flows_without_vectors(spark):
    """A flow without a vector has one made of its text, and is found by the same text."""
    rows = [("u1", "steel a", "PRODUCT_FLOW", [], "kg", None, "steel text"), ("u2", "steel b", "PRODUCT_FLOW", [], "kg", None, "other text"), ("u3", "steel c", "PRODUCT_FLOW", [], "kg", None, None)]
    flows = spark.createDataFrame([(1, "steel", "Raw Material", "kg", None, "steel text")], ASKED)
    got = matching.match_flows(flows, spark.createDataFrame(rows, MATCHED)).orderBy("rank").collect()
    assert [r["uuid"] for r in got][0] == "u1" and got[0]["similarity"] == 1.0 and len(got) == 3


def test_functional_units(spark):
    scopes = spark.createDataFrame([(1, 2, "later", "p"), (1, 1, "one kg", "p"), (2, 1, "", "Function Unit"), (3, 1, None, "only"), (5, 1, None, None)], "session_id long, seq int, description string, parameter_name string")
    flows = spark.createDataFrame([(1, "b steel", "Raw Material", 1), (1, "a steel", "Raw Material", 2), (1, "gas", "Gas", 3), (4, "iron", "Raw Material", 1), (5, "iron", "Raw Material", 1), (5, None, "Raw Material", 2)], "session_id long, name string, category string, seq int")
    got = {r["session_id"]: r["functional_unit"] for r in matching.functional_units(scopes, flows).collect()}
    assert got == {1: "one kg (materials: b steel, a steel)", 2: "Function Unit", 3: "only", 4: "Materials: iron", 5: "Materials: iron, "}


@pytest.mark.parametrize(
    "row, said",
    [
        (("Solid Waste", "Waste", "316L stainless steel washers", "SLM machine", "Steel and copper, titanium powder"), "Solid Waste 316l stainless steel SLM steel copper Waste"),
        (("Steel", "Raw Material", "steel part", None, "short"), "Steel Raw Material"), (("x", "Gas", None, "10% of input", None), "Gas"),
    ],
)
def test_context_query(spark, row, said):
    df = spark.createDataFrame([row], "n string, c string, u string, note string, k string")
    assert df.select(matching.context_query(*[F.col(c) for c in ("n", "c", "u", "note", "k")]).alias("q")).first()["q"] == said


def test_batch_match(spark):
    catalog = spark.createDataFrame([("u1", "steel", "PRODUCT_FLOW", [], "kg", None, "a"), ("u2", "steel plate", "PRODUCT_FLOW", [], "t", None, "b"), ("u3", "steel waste", "WASTE_FLOW", [], "MJ", None, "c")], MATCHED)
    flows = spark.createDataFrame(
        [(1, 1, "Steel", "Raw Material", "kg", None, None), (1, 2, "plate x", "Raw Material", "kg", "note", None), (1, 3, "Steel", "Product", "kg", None, None), (2, 1, "nothing", "Gas", None, None, None), (2, 2, None, None, None, None, None)],
        "session_id long, seq int, name string, category string, unit string, note string, chunk string",
    )
    scopes = spark.createDataFrame([(1, 1, "a part", "p")], "session_id long, seq int, description string, parameter_name string")
    got = {(r["session_id"], r["seq"]): ([m["uuid"] for m in r["matches"]], r["skipped"]) for r in matching.batch_match(flows, scopes, catalog).collect()}
    assert got == {(1, 1): (["u1"], None), (1, 2): (["u2"], None), (1, 3): ([], matching.SKIPPED), (2, 1): ([], None), (2, 2): ([], None)}


def test_batch_texts_are_read_once(spark):
    """What is asked alike is read and told once: rows meet their queries by what they ask, products too."""
    catalog = spark.createDataFrame([("u1", "steel", "PRODUCT_FLOW", [], "kg", None, "a")], MATCHED)
    flows = spark.createDataFrame(
        [(s, i, "Steel", c, "kg", n, k) for s in (1, 2, 3) for i, (c, n, k) in enumerate([("Gas", "laser milling", None), ("Gas", "Milling, then a laser", None), ("Product", None, "steel and copper"), ("Gas", None, None), (None, "", "short")])],
        "session_id long, seq int, name string, category string, unit string, note string, chunk string",
    )
    scopes = spark.createDataFrame([(1, 1, "nylon", "p"), (2, 1, "Nylon clip", "p")], "session_id long, seq int, description string, parameter_name string")
    made = matching.batch_match(flows, scopes, catalog)
    got = {(r["session_id"], r["seq"]): (r["query"], len(r["matches"])) for r in made.collect()}
    assert len(got) == 15 and {got[1, i] == got[2, i] for i in range(5)} == {True}
    assert got[1, 0] == ("Steel nylon milling laser Gas", 1) and got[1, 1] == ("Steel nylon Milling laser Gas", 1) and got[1, 2] == ("Steel nylon copper Product", 0)
    assert got[1, 3] == ("Steel nylon Gas", 1) and got[3, 3] == ("Steel Gas", 1) and got[3, 4] == ("Steel", 1) and got[3, 0] == ("Steel milling laser Gas", 1)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(note" not in plan and "regexp_extract_all(lower(CASE" not in plan


def test_batch_counts(spark):
    """Counts by what flows ask say what every flow's own answer says, and the query's look-ups read no flow again."""
    from millrace.plans.q_matching import QUERIES

    catalog = spark.createDataFrame([("u1", "steel", "PRODUCT_FLOW", [], "kg", None, "a"), ("u2", "steel plate", "PRODUCT_FLOW", [], "t", None, "b")], MATCHED)
    kinds = [("Steel", "Gas", "kg", "laser milling", None), ("plate x", "Raw Material", "kg", None, None), ("plate x", "Raw Material", None, "", "short"), ("Steel", "Product", "kg", None, "steel and copper"), (None, None, None, None, None)]
    flows = spark.createDataFrame([(s, i, *kinds[(s + i) % 5]) for s in range(1, 7) for i in range(4)], "session_id long, seq int, name string, category string, unit string, note string, chunk string")
    scopes = spark.createDataFrame([(1, 1, "nylon", "p"), (2, 1, "Nylon clip", "p"), (9, 1, "of no flow", "p")], "session_id long, seq int, description string, parameter_name string")
    said = "name", "category", "unit", "query", F.to_json("matches").alias("matches"), "skipped"
    each = matching.batch_match(flows, scopes, catalog).groupBy(*said).count().collect()
    counted = matching.batch_counts(flows, scopes, catalog).groupBy(*said).agg(F.sum("n")).collect()
    assert sorted(map(repr, map(tuple, each))) == sorted(map(repr, map(tuple, counted))) and sum(r[-1] for r in counted) == 24
    plan = QUERIES["batch_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan and "p_partkey" in plan


def brute_nearest(queries, corpus, k, metric="cosine", eps=0.0, least=None, digits=9, per=None):
    out = set()
    for qi, q in queries:
        scored = []
        for vi, v, g in corpus:
            if v is None or len(v) != len(q) or vi == qi:
                continue
            if metric == "euclid":
                scored.append((round(math.dist(q, v), digits), vi, g))
            else:
                n = math.hypot(*q) * math.hypot(*v) + eps
                c = sum(a * b for a, b in zip(q, v)) / n if n else math.nan
                if not math.isnan(c) and (least is None or c >= least):
                    scored.append((-round(c, digits), vi, g))
        groups = sorted({s[2] for s in scored}, key=str) if per else [None]
        for g in groups:
            best = sorted(s[:2] for s in scored if per is None or s[2] == g)[:k]
            out |= {(qi, vi, round(abs(s) if metric == "euclid" else -s, 7) + 0.0, r + 1) for r, (s, vi) in enumerate(best)}
    return out


@pytest.mark.parametrize("more", [{}, {"eps": 1e-8}, {"least": 0.4}, {"metric": "euclid"}, {"per": "label"}, {"metric": "euclid", "per": "label"}])
@pytest.mark.parametrize("sent", [1 << 20, 200])
def test_nearest_against_plain_python(spark, monkeypatch, more, sent):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vectors, "CORPUS_BLOCK", 16)
    rng = random.Random(5)
    corpus = [(i, [rng.choice([0.0, 1.0, 2.5, -1.0]) for _ in range(3)], rng.choice(["a", "b", None])) for i in range(150)]
    corpus += [(200 + i, [1.0, 2.0, 3.0], "a") for i in range(40)] + [(300, None, "a"), (301, [1.0], "b"), (302, [0.0, 0.0, 0.0], "a"), (303, [1e-9, 0.0, 0.0], "b")]
    queries = [(i, v) for i, v, _ in corpus if i % 15 == 0 and v is not None and len(v) == 3] + [(1000, [1.0, 2.0, 3.0]), (302, [0.0, 0.0, 0.0])]
    q = spark.createDataFrame(queries, "query_id long, q array<double>")
    c = spark.createDataFrame(corpus, "vec_id long, v array<double>, label string").repartition(3)
    got = vectors.nearest(q, c, 7, sent_bytes=sent, carry=("label",), **more).collect()
    labels = {i: g for i, _, g in corpus}
    assert all(r["label"] == labels[r["vec_id"]] for r in got)
    assert {(r["query_id"], r["vec_id"], round(r["score"], 7) + 0.0, r["rank"]) for r in got} == brute_nearest(queries, corpus, 7, **more)


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "query_id long, q array<double>"), spark.createDataFrame([], "vec_id long, v array<double>, label int")
    some = spark.createDataFrame([(1, [1.0])], "query_id long, q array<double>"), spark.createDataFrame([(2, [1.0], 7)], "vec_id long, v array<double>, label int")
    for q, c in ((none[0], some[1]), (some[0], none[1]), none):
        assert vectors.nearest(q, c, 3, carry=("label",)).collect() == []
    assert [tuple(r) for r in vectors.nearest(*some, 3, carry=("label",)).collect()] == [(1, 2, 1.0, 1, 7)]


def test_no_row_for_each_pair(spark):
    """Only the best rows of each query leave a task."""
    c = spark.range(2000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.col("id") * i % 17).cast("double")).alias("v")).repartition(4)
    q = c.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    plan = vectors.nearest(q, c, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan and "MapInArrow" in plan


def test_processes(spark):
    processes = spark.range(600).select(F.format_string("p%03d", "id").alias("uuid"), F.concat(F.lit("process "), "id").alias("name"), F.array(F.lit("x")).alias("categories"))
    asked = spark.createDataFrame([(1, "process 3", "x"), (2, "process 550", "x"), (3, "abc", None)], "query_id long, name string, location string")
    got = matching.match_processes(asked, processes, k=2).collect()
    assert {(r["query_id"], r["uuid"]) for r in got if r["similarity"] == 1} == {(1, "p003")} and len(got) == 6  # the 551st is no candidate


def test_process_pairs_stay_in_their_task(spark):
    """Queries meet all candidates as matrices: no row for each pair; equal candidates go by uuid, repeated queries share their ranks."""
    asked = spark.createDataFrame([(1, "a", "X"), (2, "b", None), (3, None, None)], "query_id long, name string, location string")
    known = spark.createDataFrame([("2", "a", ["X"]), ("10", "a", ["X"]), ("1", "b", [])], "uuid string, name string, categories array<string>")
    made = matching.match_processes(asked, known, k=2)
    got = {(r["query_id"], r["rank"]): (r["uuid"], r["similarity"]) for r in made.collect()}
    assert got[1, 1] == ("10", 1.0) and got[1, 2] == ("2", 1.0) and len(got) == 6
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_all_processes(spark, monkeypatch):
    """Without a bound every process is a candidate, whatever tasks the pairs fall into; equal texts go by uuid."""
    monkeypatch.setattr(matching, "SHARE", 150)
    monkeypatch.setattr(matching, "BLOCK", 7)
    monkeypatch.setattr(vectors, "_LOOK_QUERIES", 3)
    monkeypatch.setattr(vectors, "_LOOK_ROWS", 64)
    known = [(f"p{i:03d}", f"process {i}", ["x"]) for i in range(600)] + [(f"q{i}", "same", ["x", None]) for i in range(9)] + [(None, "process 7", ["x"]), ("p000", None, None)]
    asked = [(i, f"process {i * 29}", "x") for i in range(20)] + [(50, "same", "x"), (51, "same", "x"), (51, "abc", None), (52, None, "")]
    processes = spark.createDataFrame(known, "uuid string, name string, categories array<string>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id int, name string, location string")
    md5 = lambda text: np.tile(np.frombuffer(hashlib.md5(text.encode()).digest(), np.uint8) / 255, 4)
    vecs = [(u, md5(" ".join([n or "", *(c for c in cs or [] if c is not None)]))) for u, n, cs in known]
    want = {}
    for q, n, place in asked:
        v = md5(" ".join(x for x in (n, place or None) if x is not None))
        want.setdefault(q, []).extend((-round(float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), 9), u or "") for u, w in vecs)
    want = {(q, r): (u, -s) for q, found in want.items() for r, (s, u) in enumerate(sorted(found)[:4], 1)}
    got = matching.match_processes(queries, processes, k=4, most=None)
    told = {(r["query_id"], r["rank"]): (r["uuid"] or "", r["similarity"]) for r in got.collect()}
    assert told.keys() == want.keys() and all(told[x][0] == want[x][0] and abs(told[x][1] - want[x][1]) < 6e-7 for x in want)
    assert dict(got.dtypes)["query_id"] == "int" and {(r["query_id"], r["uuid"]) for r in got.collect() if r["similarity"] == 1} >= {(19, "p551"), (51, "q0"), (51, "q3")}
    assert matching.match_processes(queries, processes.limit(0), most=None).collect() == matching.match_processes(queries.limit(0), processes, most=None).collect() == []
    assert matching.match_processes(queries.limit(1), processes.limit(3), most=None).count() == 3


def test_process_match_reads_all_processes(spark, tmp_path):
    """A process beyond the first 500 is found where it is the best."""
    spark.range(700).selectExpr("id AS p_partkey", "'part ' || id AS p_name", "'B' AS p_brand", "'T' AS p_type", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("SELECT 1L AS s_suppkey, 'part 699 T B Emission to water' AS s_name, 0 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("SELECT 0 AS n_nationkey, 'N' AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    best = q_matching.QUERIES["process_match"](spark, str(tmp_path)).where("rank = 1").collect()
    assert [(r["uuid"], r["similarity"]) for r in best] == [("699", 1.0)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_recorded_flows_are_many_small_tasks(spark, monkeypatch):
    """Recorded flows are as many tasks as their number needs, and meet their mappings there without another shuffle."""
    sf = "/root/testdata/sf0.001"
    whole = {tuple(r) for r in q_matching.QUERIES["lcia_calculation"](spark, sf).collect()}
    monkeypatch.setattr(q_matching, "_TASK", 500)
    rows = q_matching._recorded(spark, sf)
    assert rows.rdd.getNumPartitions() == -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500) > 4
    made = matching.exchanges(rows, q_matching._mapping(spark, sf), q_matching.V.catalog(spark, sf), q_matching._KEY)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and plan.count("REPARTITION_BY_NUM") == 2
    assert {tuple(r) for r in q_matching.QUERIES["lcia_calculation"](spark, sf).collect()} == whole
