"""The corpus pipeline, stage by stage, against plain Python, and the queries that SQL can express."""

import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from millrace.llm import decontamination, queries
from millrace.llm.shared import staged
from tests.llm.test_dedup import brute, repeats
from tests.llm.test_scores import brute_score
from tests.llm.test_tokens import check_bins, whole

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns, ids = docs.columns, whole("word_bpe_49k.json")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = staged(stage(spark, docs, SF), name)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            model = queries.toxicity_model(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels"))
            want = {r["doc_id"] for r in before if brute_score(model, r["text"]) < 0.3}
            assert {r["doc_id"] for r in after} == want and 0.5 * len(before) < len(want) < len(before)
        elif name == "near_dedup":
            want = {d for d, (_, component, _) in brute([(r["doc_id"], r["text"]) for r in before], 5, 80).items() if component == d}
            assert {r["doc_id"] for r in after} == want and len(want) < len(before)
        elif name == "substring_dedup":
            kept = {r["doc_id"]: words for r, (_, words) in zip(before, repeats([(r["doc_id"], r["text"]) for r in before], 50))}
            assert {r["doc_id"]: (r["text"] or "").encode().split() for r in after} == kept
            assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)
        elif name == "decontamination":
            items = [decontamination.normal(r["text"]).split() for r in queries.table(spark, SF, "benchmark").collect()]
            holds = lambda t: any(decontamination.myers(i, decontamination.normal(t or "").split(), decontamination.budget(len(i), 0.1)) for i in items)
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not holds(r["text"])}
        else:
            want = []
            for r in before:
                x = np.append(ids(r["text"]), np.uint32(0)).astype("<u4")
                want += [(r["doc_id"], k, at, len(x[at : at + 2048]), zlib.crc32(x[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(x), 2048))]
            pieces = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
            assert pieces(after) == sorted(want)
            check_bins(after, 2048)
            assert pieces(corpus_pipeline.run(spark, SF).collect()) == sorted(want)


def test_stages_take_odd_rows(spark, odd, none):
    """Each stage on the odd rows and on none, row by row."""
    shaped = lambda rows: rows.selectExpr("doc_id", "text", "label AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars", "bands")
    docs, stages = shaped(odd), dict(corpus_pipeline.STAGES)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    for name, stage in stages.items():
        assert stage(spark, shaped(none), SF).collect() == [] and (name == "packing" or stage(spark, docs, SF).columns == docs.columns)
    model = queries.toxicity_model(docs, queries.table(spark, SF, "labels"))
    assert pairs(stages["toxicity"](spark, docs, SF)) == sorted((r for r in rows if brute_score(model, r[1]) < 0.3), key=str)
    components = {}
    for i, (n, component, _) in brute(list(enumerate(t for _, t in rows)), 5, 80).items():
        components.setdefault(component if n else ("alone", i), []).append(rows[i])
    kept = pairs(stages["near_dedup"](spark, docs, SF))
    assert len(kept) == len(components)
    for members in components.values():
        least = min((d for d, _ in members), key=lambda d: (d is not None, d or 0))
        assert any(k[0] == least and k in members for k in kept)
    cut = pairs(stages["substring_dedup"](spark, docs, SF))
    assert sorted(((d, (t or "").encode().split()) for d, t in cut), key=str) == sorted(((r[0], words) for r, (_, words) in zip(rows, repeats(rows, 50))), key=str)
    assert pairs(stages["decontamination"](spark, docs, SF)) == sorted(rows, key=str)
    ids, packed = whole("word_bpe_49k.json"), stages["packing"](spark, docs, SF).collect()
    check_bins(packed, 2048)
    assert sum(r["length"] for r in packed) == sum(len(ids(t)) + 1 for _, t in rows) and sum(r["piece"] == 0 for r in packed) == len(rows)


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in names) if m} == set(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    told, got = con.sql(queries.ORACLE[name]), queries.QUERIES[name](spark, SF).select
    assert sorted(map(str, got(*told.columns).collect())) == sorted(map(str, [spark_row(told.columns, r) for r in told.fetchall()]))


def spark_row(columns, values):
    from pyspark.sql import Row

    return Row(**dict(zip(columns, values)))


def test_public_vocabularies_are_found():
    assert public_tokenizers.path("word_bpe_49k.json").endswith("word_bpe_49k.json")
