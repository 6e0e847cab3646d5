"""Exact nearest vectors: blocks of vectors are multiplied as matrices, and only each query's best rows leave a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and corpus rows of one matrix product.
QUERY_BLOCK, CORPUS_BLOCK = 1024, 4096
#: Query vectors up to so many bytes go to every task; more meet the corpus in shares.
SENT_BYTES = 32 << 20


class Best:
    """The ``k`` best corpus rows of each query, of each group's rows apart, as rows arrive.

    Cosines are rounded to ``digits``, the highest are best; of distances the least. Equal ones go by id.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, metric: str, eps: float, least: float | None, digits: int):
        self.ids, self.queries, self.k, self.eps, self.least, self.digits = ids, queries, k, eps, least, digits
        self.euclid = metric == "euclid"
        self.norms = np.sqrt((queries * queries).sum(axis=1))
        self.found: dict[tuple, list[tuple]] = {}
        self.kinds: list[pa.DataType] = []  # of carried values

    def _keys(self, q: slice, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Less is better: the rounded cosine's negative, or about the squared distance."""
        dots = self.queries[q] @ vectors.T
        if self.euclid:
            return self.norms[q, None] ** 2 + norms**2 - 2 * dots
        with np.errstate(divide="ignore", invalid="ignore"):
            cosines = dots / (self.norms[q, None] * norms + self.eps)
        off = np.isnan(cosines) if self.least is None else ~(cosines >= self.least)
        return np.where(off, np.inf, -np.round(cosines, self.digits))

    def add(self, ids: np.ndarray, vectors: np.ndarray, carried: list[tuple], groups: np.ndarray | None) -> None:
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        parts = [(None, np.arange(len(ids)))] if groups is None else [(g, np.flatnonzero(groups == g)) for g in pd.unique(groups)]
        for group, rows in parts:
            for at in range(0, len(rows), CORPUS_BLOCK):
                some = rows[at : at + CORPUS_BLOCK]
                for first in range(0, len(self.ids), QUERY_BLOCK):
                    q = slice(first, first + QUERY_BLOCK)
                    keys = self._keys(q, vectors[some], norms[some])
                    keys[self.ids[q, None] == ids[some]] = np.inf
                    self._merge(first, keys, group, some, ids, vectors, norms, carried)

    def _merge(self, first: int, keys: np.ndarray, group, some: np.ndarray, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, carried: list[tuple]) -> None:
        # a product's squared distance may be off in its last digits: what is that near is measured anew
        slack = 1e-9 * (self.norms[first : first + len(keys)] + norms[some].max(initial=0)) ** 2 + 1e-12 if self.euclid else np.zeros(len(keys))
        for i, row in enumerate(keys):
            old = self.found.get((first + i, group), [])
            limit = np.inf if len(old) < self.k else old[-1][0] ** 2 + slack[i] if self.euclid else old[-1][0]
            near = np.flatnonzero((row <= limit) & (row < np.inf))
            if len(near) > self.k:
                near = near[row[near] <= np.partition(row[near], self.k - 1)[self.k - 1] + slack[i]]
            if not len(near):
                continue
            at = some[near]
            key = row[near]
            if self.euclid:
                key = np.round(np.sqrt(((vectors[at] - self.queries[first + i]) ** 2).sum(axis=1)), self.digits)
            order = np.lexsort((ids[at], key))[: self.k]
            new = [(float(key[o]), ids[at[o]].item(), carried[at[o]] if carried else ()) for o in order]
            self.found[first + i, group] = sorted(old + new, key=lambda r: r[:2])[: self.k]

    def rows(self) -> list[tuple]:
        """(query id, corpus id, cosine or distance, carried values), group by group."""
        sign = 1 if self.euclid else -1
        return [(self.ids[q].item(), r[1], sign * r[0] + 0.0, *r[2]) for (q, _), best in self.found.items() for r in best]


#: Queries and corpus rows that :func:`most_alike` looks at together.
_LOOK_QUERIES, _LOOK_ROWS = 256, 2048


def most_alike(queries: np.ndarray, corpus: np.ndarray, k: int, digits: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``corpus`` of each query's ``k`` highest cosines, and these, rounded to ``digits``; equal ones in order.

    Products in single precision tell which rows may be among the best, with more slack than their error; only these have
    their cosines made. All vectors are finite and none is nought.
    """
    k = min(k, len(corpus))
    found, cosines = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k))
    norms, sizes = (np.sqrt((m * m).sum(axis=1)) for m in (queries, corpus))
    low, high = (queries / norms[:, None]).astype(np.float32), (corpus / sizes[:, None]).astype(np.float32)
    slack = np.float32(4 * (corpus.shape[1] + 4) * np.finfo(np.float32).eps)
    for at in range(0, len(queries) if k else 0, _LOOK_QUERIES):
        some = low[at : at + _LOOK_QUERIES]
        best, hits, first, step = np.full((len(some), k), -np.inf, np.float32), [], 0, max(k, _LOOK_ROWS // 16)
        while first < len(high):
            products = some @ high[first : first + step].T
            least = best.min(axis=1) - slack
            better = np.flatnonzero(products.max(axis=1) >= least)
            if len(better):
                products = products[better]
                row, column = np.divmod(np.flatnonzero(products >= least[better, None]), products.shape[1])
                value = products[row, column]
                hits.append((better[row], first + column, value))
                n = np.bincount(row)
                new = np.full((len(better), n.max()), -np.inf, np.float32)
                new[row, np.arange(len(row)) - (np.cumsum(n) - n)[row]] = value
                best[better] = np.partition(np.concatenate([best[better], new], axis=1), new.shape[1], axis=1)[:, new.shape[1] :]
            first, step = first + step, min(4 * step, _LOOK_ROWS)
        row, place, value = (np.concatenate(x) for x in zip(*hits))
        may = value >= (best.min(axis=1) - slack)[row]
        row, place = row[may], place[may]
        cosine = np.round(np.einsum("ij,ij->i", queries[at + row], corpus[place]) / (norms[at + row] * sizes[place]), digits)
        order = np.lexsort((place, -cosine, row))
        n = np.bincount(row, minlength=len(some))
        order = order[np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n) < k].reshape(-1, k)
        found[at : at + len(some)], cosines[at : at + len(some)] = place[order], cosine[order]
    return found, cosines


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dims)


def nearest(
    queries: DataFrame, corpus: DataFrame, k: int, *, metric: str = "cosine", eps: float = 0.0, least: float | None = None, digits: int = 9,
    carry: tuple[str, ...] = (), per: str | None = None, sent_bytes: int = SENT_BYTES,
) -> DataFrame:
    """query_id, vec_id, score, rank and the columns of ``carry``: the ``k`` best rows of ``corpus`` for each query but itself.

    ``queries`` (query_id long, q array<double>) is a stated query set, ``corpus`` (vec_id long, v array<double>) all rows.
    ``score`` is the cosine (with ``eps`` added to the norms' product; at least ``least``) or, by ``euclid``, the distance,
    rounded to ``digits``; ranks follow the rounded score, then vec_id. With ``per``, a column of ``corpus``, each query
    keeps its ``k`` best rows of each of that column's values, and ranks count these apart.

    Null vectors, and those of another length than the longest query's, are left out; so are cosines of nothing. Where the
    queries' vectors take no more than ``sent_bytes``, every task has them and the corpus is read in place; else blocks of
    both meet in a grid, so that neither side is ever whole in one task. A task leaves ``k`` rows for each query (and group).
    """
    spark = queries.sparkSession
    known = queries.where("q IS NOT NULL AND size(q) > 0").select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"))
    dims = known.agg(F.max(F.size("q"))).first()[0] or 0
    known = known.where(F.size("q") == dims)
    more = [c for c in dict.fromkeys((*carry, *([per] if per else [])))]
    rows = corpus.where(F.size("v") == dims).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"), *more)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(["query_id long", "vec_id long", "score double", *(f"`{c}` {kinds[c]}" for c in more)])
    names = ["query_id", "vec_id", "score", *more]
    make = lambda ids, q: Best(ids, q, k, metric, eps, least, digits)

    def add(best: Best, part) -> None:
        carried = list(zip(*(part.column(c).to_pylist() for c in more)))
        best.kinds = [part.schema.field(c).type for c in more]
        groups = None if per is None else np.array([repr(x) for x in part.column(per).to_pylist()])
        best.add(part.column("vec_id").to_numpy(), _matrix(part.column("v"), dims), carried, groups)

    def table(best: Best) -> pa.Table:
        found = list(zip(*best.rows())) or [()] * len(names)
        kinds = [pa.int64(), pa.int64(), pa.float64(), *(best.kinds or [pa.null()] * len(more))]
        return pa.table([pa.array(c, kind) for c, kind in zip(found, kinds)], names=names)

    n = known.count()
    if n * dims * 8 <= sent_bytes:
        listed = known.orderBy("query_id").collect()
        sent = spark.sparkContext.broadcast((np.array([r["query_id"] for r in listed], np.int64), np.array([r["q"] for r in listed], np.float64).reshape(n, dims)))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = make(*sent.value)
            for batch in batches:
                add(best, batch)
            if best.found:
                yield from table(best).to_batches()

        found = rows.mapInArrow(each, schema)
    else:
        blocks = -(-n * dims * 8 // sent_bytes)
        shares = max(1, -(-rows.count() // (32 * CORPUS_BLOCK)))
        upto = lambda m: F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))
        left = rows.withColumn("__share", F.pmod(F.xxhash64("vec_id"), F.lit(shares))).withColumn("__block", F.explode(upto(blocks)))
        right = known.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("__share", F.explode(upto(shares)))

        def meet(part: pa.Table, asked: pa.Table) -> pa.Table:
            best = make(asked.column("query_id").to_numpy(), _matrix(asked.column("q"), dims))
            if part.num_rows and asked.num_rows:
                add(best, part)
            return table(best)

        found = left.groupBy("__block", "__share").cogroup(right.groupBy("__block", "__share")).applyInArrow(meet, schema)
    w = Window.partitionBy("query_id", *([per] if per else [])).orderBy("score" if metric == "euclid" else F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank", *more)
