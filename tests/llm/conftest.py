import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with null ids and texts, empty, blank, short, long, repeated and near-repeated ones, and clashing columns."""
    base = " ".join(f"w{i}" for i in range(120))
    near = base.replace("w60", "x60")
    rows = [
        (1, base), (2, base), (2, base), (3, near), (4, None), (5, ""), (6, " \t\n"), (7, "One"), (8, "one  TWO"), (None, "a null id"), (None, base),
        (9, "ünïcödé ß 文字 \U0001f600 " * 30), (10, "long " * 6000 + "end"), (11, "q " + base[:200]), (12, "idiot you are a moron"), (12, "other text under one id"),
    ]
    data = [(i, t, "n", k, "s", "b", "l") for k, (i, t) in enumerate(rows)]
    names = "doc_id long, text string, node string, size int, label string, bands string, weight string"
    return spark.createDataFrame(data, names)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def rows_of():
    return lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
