"""Whitening against exact fractions and plain numpy."""

import math
import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import queries, whitening

NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def integers(v, scale=64, offset=1_000_000):
    return tuple(math.floor(c * scale) + offset for c in v)


def brute(rows, components, scale=64, offset=1_000_000):
    """(vec_id, x) of whole rows; n, S, exact covariance of the distinct vectors, its eigenvalues and vectors."""
    kept = [(i, integers(v, scale, offset)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max(len(x) for _, x in kept)
    kept = [(i, x) for i, x in kept if len(x) == dim]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(dim)] for i in range(dim)]
    e, u = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    return kept, n, sums, float(sum(cov[i][i] for i in range(dim))), e[::-1][:components], u[:, ::-1][:, :components]


def checked(spark, rows, kind="float", **more):
    got = whitening.whiten(spark.createDataFrame([(i, v, 1, "c") for i, v in rows], f"vec_id long, embedding array<{kind}>, n int, component string"), **more).collect()
    assert got[0].__fields__ == NAMES
    kept, n, sums, trace, e, u = brute(rows, more.get("components", 16), more.get("scale", 64), more.get("offset", 1_000_000))
    assert len(got) == len(kept) * len(e)
    want = {}
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        z = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)]) @ u / np.sqrt(e)
        for k in range(len(e)):
            want.setdefault((i, k + 1), []).append((deviation, abs(z[k])))
    for r in got:
        same = [w for w in want[r["vec_id"], r["component"]] if w[0] == r["deviation"]]
        assert any(math.isclose(abs(r["whitened"]), z, rel_tol=1e-6, abs_tol=1e-7) for _, z in same)
        assert r["n"] == n and math.isclose(r["explained"], e[r["component"] - 1] / trace, rel_tol=1e-9)
        assert r["identity_error"] < 1e-9
    return got


def sample(rng, n, dim):
    return [(i, [rng.gauss(0, 1 + k) + rng.choice([0, 5]) * (k == 2) for k in range(dim)]) for i in range(n)]


def test_against_fractions(spark):
    rng = random.Random(1)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in sample(rng, 300, 6)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan"), 0.0, 0.0, 0.0, 0.0, 0.0]), (403, [0.0, 0.0, 0.0, 0.0, 0.0, float("inf")]), (404, []), (405, [1.0, 2.0])]
    rows += [(None, rows[3][1])] + [(406, rows[5][1])] * 50 + [(7, rows[6][1])]
    got = checked(spark, rows, components=4)
    assert {r["vec_id"] for r in got} >= {None, 406} and not {r["vec_id"] for r in got} & {400, 401, 402, 403, 404, 405}
    signs = {(r["vec_id"], r["component"], r["whitened"]) for r in got if r["vec_id"] == 406}
    assert len(signs) == 4  # equal vectors, equal values


def test_whatever_the_offset(spark):
    """Exact sums: a large offset, where doubles lose the covariance, changes nothing."""
    rng = random.Random(2)
    rows = [(i, [round(c, 3) for c in v]) for i, v in sample(rng, 200, 5)]
    near, far = (checked(spark, rows, "double", offset=o) for o in (0, 2**40))
    key = lambda r: (r["vec_id"], r["component"])
    for a, b in zip(sorted(near, key=key), sorted(far, key=key)):
        assert (a["deviation"], a["whitened"], a["explained"]) == (b["deviation"], b["whitened"], b["explained"])


def test_large_entries(spark):
    """Deviations beyond a long are exact too."""
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1e11, 1e11) for _ in range(3)]) for i in range(120)]
    got = checked(spark, rows, "double")
    assert max(r["deviation"] for r in got) > Decimal(2**63)
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>"))


def test_sums_that_wrap():
    """Sums beyond a long leave differences right."""
    n, mean = 2**22, 2**44
    model = whitening.Model(n, [n * mean, 5 * n], 2**30, np.eye(2), [1.0, 1.0])
    assert model.sums[0] > 2**63
    assert model.centred(np.array([[mean + 3, 4]])).tolist() == [[3 * n, -n]]


def test_few_or_flat_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]):
        out = whitening.whiten(spark.createDataFrame(rows, schema))
        assert out.columns == NAMES and out.collect() == []
    flat = whitening.whiten(spark.createDataFrame([(1, [0.0, 7.0, 0.0]), (2, [1.0, 7.0, 2.0]), (3, [5.0, 7.0, 10.0])], schema)).collect()
    assert {r["component"] for r in flat} == {1} and all(math.isclose(r["explained"], 1, rel_tol=1e-9) for r in flat)


def test_residues():
    assert whitening.primes(1) == [2097143] and len(whitening.primes(2**62)) == 4 and len(whitening.primes(2**63 * 100)) == 4
    rng = random.Random(4)
    for _ in range(200):
        v = rng.randrange(-(2**90), 2**90)
        moduli = whitening.primes(2**90)
        assert whitening.remaindered([v % p for p in moduli], moduli) == v
    x = np.array([[2**47, -(2**47)], [3, 5]])
    for p in whitening.primes(2**60):
        got = whitening.centred_residues(x, 10**10, [17, -(2**70)], p)
        want = [[(10**10 * int(c) - s) % p for c, s in zip(r, [17, -(2**70)])] for r in x]
        assert (got.astype(np.int64) % p).tolist() == want and np.abs(got).max() <= p / 2


def test_query(spark):
    got = queries.op12_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes)["deviation"] == "bigint" and got.columns == NAMES
    rows = got.collect()
    assert {r["component"] for r in rows} == set(range(1, 17)) and len({r["identity_error"] for r in rows}) == 1
    assert rows[0]["identity_error"] < 1e-9
