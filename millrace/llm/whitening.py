"""Whitening of embeddings from an exact scatter matrix in residue numbers.

Entries become integers x = floor(scale * c) + offset. The fit list is each distinct x vector once: n vectors with sums S.
Centred entries y = n * x - S are integers too. Each task takes their residues modulo several primes below 2**21 and
multiplies blocks of rows in double precision: products of centred residues stay below 2**53 in a block, so every matrix
product is exact. Residues are summed by Spark, one row for each prime and cell, and put together by Chinese remaindering:
the scatter of y is exact, whatever the offset, the number of rows and the order in which tasks end. The primes are as many
as a measured bound on the scatter needs. What the driver holds grows with the square of the dimension alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import drop_staged, staged

SCALE, OFFSET = 64, 1_000_000
#: Rows of a block, and the primes' bound: 2**12 products of two centred residues, each below 2**20, sum to less than 2**53.
BLOCK, BELOW = 4096, 2**21
#: x stays within a long with room for sums of a block.
LARGEST = 2**48


def primes(bound: int) -> list[int]:
    """The largest primes below ``BELOW`` whose product is more than twice ``bound``."""
    out, product, p = [], 1, BELOW - 1
    while product <= 2 * bound:
        if all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The integer of least size with these residues."""
    value, product = 0, 1
    for r, p in zip(residues, moduli):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def integers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of each entry, as longs. What is too large for these stays beyond ``LARGEST``."""
    most = 2.0**60
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-most)), F.lit(most))) + F.lit(offset).cast("long"))


def finite(vector: Column) -> Column:
    """Whether a vector is there, and all its entries are numbers."""
    off = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, lambda c: off(c.cast("double")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, _matrix(part.column(column), dim)


_SUMS = "dim int, n long, low long, high long, least long, most long"


def _summed(dim: int):
    """For each dimension: rows, sums of the halves above and below 2**24, least and largest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 0, dim):
            rows = [np.full(dim, len(x)), (x & (2**24 - 1)).sum(axis=0), (x >> 24).sum(axis=0), x.min(axis=0), x.max(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), *(pa.array(r.astype(np.int64)) for r in rows)], _SUMS.replace(" int", "").replace(" long", "").split(", "))

    return run


def centred_residues(x: np.ndarray, n: int, sums: list[int], p: int) -> np.ndarray:
    """(n * x - S) modulo p, between -p / 2 and p / 2, as doubles."""
    r = ((x % p) * (n % p) - np.array([s % p for s in sums], np.int64)) % p
    return np.where(r > p // 2, r - p, r).astype(np.float64)


def _scattered(n: int, sums: list[int], moduli: list[int]):
    dim = len(sums)
    cells = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(moduli), len(cells[0])), np.int64)
        for _, x in _blocks(batches, 0, dim):
            for k, p in enumerate(moduli):
                y = centred_residues(x, n, sums, p)
                totals[k] = (totals[k] + (y.T @ y)[cells].astype(np.int64)) % p
        if totals.any():
            prime = np.repeat(np.arange(len(moduli), dtype=np.int32), len(cells[0]))
            cell = np.tile(np.arange(len(cells[0]), dtype=np.int32), len(moduli))
            yield pa.RecordBatch.from_arrays([pa.array(prime), pa.array(cell), pa.array(totals.ravel())], ["prime", "cell", "residue"])

    return run


@dataclass(frozen=True)
class Model:
    """n rows with sums S of a fit list, its axes (a column for each component) over the roots of their variances, and the variances' shares."""

    n: int
    sums: list[int]
    reach: int  # no |n * x - S| is larger
    axes: np.ndarray
    explained: list[float]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        if self.reach < 2**62:  # products and sums may wrap, differences come out right
            return x * np.int64(self.n) - np.array([(s + 2**63) % 2**64 - 2**63 for s in self.sums], np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.axes

    def deviations(self, centred: np.ndarray) -> list[int] | np.ndarray:
        """Sums of squares of each row, exactly."""
        if self.reach**2 * len(self.sums) < 2**63:
            return (centred * centred).sum(axis=1)
        exact = centred.astype(object)
        return (exact * exact).sum(axis=1).tolist()


def scatter(fit_list: DataFrame, n: int, sums: list[int], reach: int) -> list[list[int]]:
    """The exact sums of products of n * x - S over a staged table (x array<long>) of n rows."""
    dim = len(sums)
    moduli = primes(n * reach * reach)
    rows = fit_list.select("x").mapInArrow(_scattered(n, sums, moduli), "prime int, cell int, residue long")
    found: dict[int, list[int]] = {}
    for r in rows.groupBy("prime", "cell").agg(F.sum("residue").alias("r")).toLocalIterator():
        found.setdefault(r["cell"], [0] * len(moduli))[r["prime"]] = r["r"] % moduli[r["prime"]]
    out = [[0] * dim for _ in range(dim)]
    for cell, (i, j) in enumerate(zip(*(a.tolist() for a in np.triu_indices(dim)))):
        if cell in found:
            out[i][j] = out[j][i] = remaindered(found[cell], moduli)
    return out


def axes_of(scattered: list[list[int]], n: int, components: int) -> tuple[np.ndarray, list[float]]:
    """Unit eigenvectors of the covariance over the roots of its eigenvalues, and their shares of the trace.

    They come by falling eigenvalue, each with its largest entry positive. Eigenvalues that are nought in double
    precision have no whitened form, and their components are left out.
    """
    cube = n**3
    v = np.array([[cell / cube for cell in row] for row in scattered])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    real = int((e > len(e) * np.finfo(float).eps * max(float(e[0]), 0.0)).sum())
    e, u = e[: min(real, components)], u[:, : min(real, components)]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    trace = sum(scattered[i][i] for i in range(len(scattered))) / cube
    return u / np.sqrt(e), [float(x / trace) for x in e]


def fit(fit_list: DataFrame, dim: int, components: int) -> Model | None:
    """The model of a staged table of distinct integer vectors, of ``dim`` entries each; None where there is none."""
    rows = fit_list.select("x").mapInArrow(_summed(dim), _SUMS).groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"),
        F.min("least").alias("least"), F.max("most").alias("most"),
    )
    found = sorted(rows.collect(), key=lambda r: r["dim"])
    if not found:
        return None
    if max(max(abs(r["least"]), abs(r["most"])) for r in found) > LARGEST:
        raise ValueError(f"entries are beyond {LARGEST} once scaled")
    n, sums = found[0]["n"], [int(r["low"]) + (int(r["high"]) << 24) for r in found]
    reach = max(max(abs(n * r["least"] - s), abs(n * r["most"] - s)) for r, s in zip(found, sums))
    axes, explained = axes_of(scatter(fit_list, n, sums, reach), n, components)
    return Model(n, sums, reach, axes, explained)


def identity_error(fit_list: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, measured on its rows."""
    k = model.axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for _, x in _blocks(batches, 0, len(model.sums)):
            z = model.whitened(model.centred(x))
            total[:k] += z.T @ z
            total[k] += z.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * (k + 1), dtype=np.int32)), pa.array(total.ravel())], ["cell", "v"])

    rows = fit_list.select("x").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(k * (k + 1))
    for r in rows:
        total[r["cell"]] = r["v"]
    total = total.reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max()) if k else 0.0


def whiten(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = SCALE, offset: int = OFFSET,
) -> DataFrame:
    """id, component, n, deviation (decimal(38,0)), whitened, explained and identity_error: a row for each vector and component.

    Vectors that are null or hold null or non-finite entries are left out; the dimension is that of the longest other,
    and shorter ones, whose last entries are missing, are left out too. Equal vectors count once in the fit and each has
    its rows. A null id stays null; ids may repeat. There are at most ``components`` components, and as many as the
    covariance has eigenvalues above nought: none for a single distinct vector, which gives no rows, as no vectors do.
    Entries beyond ``LARGEST`` once scaled raise ValueError.
    Other columns are not read. The fit list is written to the shared folder and dropped once the model is made.
    """
    read = rows.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__v")).where(finite(F.col("__v")))
    read = read.select("__id", integers(F.col("__v"), scale, offset).alias("x"))
    fit_list = staged(read.select("x").distinct(), "fit")
    try:
        dim = fit_list.agg(F.max(F.size("x"))).first()[0] or 0
        whole = F.size("x") == dim
        model = fit(fit_list.where(whole), dim, components) if dim else None
        error = identity_error(fit_list.where(whole), model) if model else 0.0
    finally:
        drop_staged(fit_list)
    schema = "id {}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    schema = schema.format(read.schema["__id"].dataType.simpleString())
    if model is None or not model.explained:
        return read.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    k, names = len(model.explained), [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1, dim):
            m = len(x)
            centred = model.centred(x)
            deviation = model.deviations(centred)
            exact = pa.array(deviation).cast(pa.decimal128(38, 0)) if isinstance(deviation, np.ndarray) else pa.array([Decimal(d) for d in deviation], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [
                part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), exact.take(each),
                pa.array(model.whitened(centred).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return read.where(whole).mapInArrow(run, schema).withColumnRenamed("id", id_col)
