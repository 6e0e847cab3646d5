"""Values carried along ordered rows of a key, however many rows one key has.

Rows are dealt by their key alone, once for all that is carried along them. Only a key with more rows than a task's share is
dealt by ranges of its order, so that it is many tasks. What a range's rows need from the ranges beside it is one value
for each range, and such keys alone are looked at for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import checkpointed

#: Fixed value: a key with so many rows at most is one range, where the number of parts is not given.
LEAST = 10_000
_PART = "__part"


def borders(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame | None:
    """(``keys``, __from): where the ranges begin of each key that has more than half a part's share of ``rows``; None if no key has.

    There are at most twice ``parts`` such keys, and twice as many ranges. They are written once, so that all that asks
    for them sees the same ones.
    """
    ranges = 2 * (parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = max(rows.count() // ranges, 1 if parts else LEAST)
    many = checkpointed(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > share))
    if many.isEmpty():
        return None
    many = many.select(*(F.col(k).alias(f"__b_{k}") for k in keys))
    own = rows.select(*keys, *order).join(F.broadcast(many), _same(keys, "", "__b_"), "left_semi")
    own = own.repartitionByRange(ranges, *keys, *order).withColumn(_PART, F.spark_partition_id())
    begun = own.groupBy(*keys, _PART).agg(F.min(F.struct(*order)).alias("__from"))
    return checkpointed(begun.groupBy(*(F.col(k).alias(f"__b_{k}") for k in keys)).agg(F.array_sort(F.collect_list("__from")).alias("__from")))


def _same(keys: list[str], a: str, b: str) -> list[Column]:
    return [F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys]


class Dealt:
    """Rows that are dealt by ``keys``, and by ranges of ``order`` for the keys of :func:`borders`.

    Of rows that no filter kept some, ``of`` may be the whole, whose keys are quicker to count. ``begun``: what :func:`borders`
    gave, where several are dealt alike; True if it is still to be asked.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None, of: DataFrame | None = None, begun: DataFrame | bool | None = True):
        self.keys, self.order = keys, order
        begun = borders(rows if of is None else of, keys, order, parts) if begun is True else begun
        self.by = keys if begun is None else [_PART, *keys]
        if begun is not None:
            met = rows.join(F.broadcast(begun), _same(keys, "", "__b_"), "left")
            place = F.greatest(F.size(F.filter("__from", lambda b: b <= F.struct(*order))), F.lit(1))
            rows = met.withColumn(_PART, F.when(F.col("__from").isNull(), 0).otherwise(place)).select(*rows.columns, _PART)
        self.rows = rows.repartition(*([parts] if parts else []), *self.by)

    def with_column(self, name: str, value: Column) -> Dealt:
        self.rows = self.rows.withColumn(name, value)
        return self

    def carry(self, **wanted: tuple[str, Column]) -> Dealt:
        """A column for each of ``wanted``, as :func:`carried` says; rows stay where they are."""
        columns, values = self.rows.columns, {name: f"__v_{name}" for name in wanted}
        rows = self.rows.select("*", *(c.alias(values[n]) for n, (_, c) in wanted.items()))
        earlier = Window.partitionBy(*self.by).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)
        over = f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in self.by)} ORDER BY {', '.join(f'`{c}`' for c in self.order)})"
        within = {
            name: F.coalesce(F.sum(values[name]).over(earlier), F.lit(0)) if kind == "total" else F.last(values[name], ignorenulls=True).over(earlier)
            if kind == "before" else F.expr(f"lead(`{values[name]}`) IGNORE NULLS {over}")
            for name, (kind, _) in wanted.items()
        }
        out = rows.select("*", *(x.alias(f"__w_{n}") for n, x in within.items()))
        if self.by == self.keys:
            self.rows = out.select(*columns, *(F.col(f"__w_{n}").alias(n) for n in wanted))
            return self
        far = self._far(rows.where(F.col(_PART) > 0), {n: (kind, values[n]) for n, (kind, _) in wanted.items()})
        out = out.join(F.broadcast(far), [F.col(_PART) == F.col("__p"), *_same(self.keys, "", "__k_")], "left")
        joined = {n: (F.col(f"__w_{n}") + F.coalesce(f"__f_{n}", F.lit(0))) if kind == "total" else F.coalesce(f"__w_{n}", f"__f_{n}") for n, (kind, _) in wanted.items()}
        self.rows = out.select(*columns, *(c.alias(n) for n, c in joined.items()))
        return self

    def _far(self, rows: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
        """What each range is given by the ranges of its key beside it."""
        edge, far = {}, {}
        crossing = Window.partitionBy(*self.keys).orderBy(_PART)
        before, after = crossing.rowsBetween(Window.unboundedPreceding, -1), crossing.rowsBetween(1, Window.unboundedFollowing)
        for name, (kind, value) in wanted.items():
            known, e = F.when(F.col(value).isNotNull(), F.struct(*self.order, F.col(value).alias("__v"))), f"__e_{name}"
            if kind == "total":
                edge[name], far[name] = F.sum(value), F.sum(e).over(before)
            elif kind == "before":
                edge[name], far[name] = F.max(known)["__v"], F.last(e, ignorenulls=True).over(before)
            else:
                edge[name], far[name] = F.min(known)["__v"], F.first(e, ignorenulls=True).over(after)
        edges = rows.groupBy(_PART, *self.keys).agg(*(e.alias(f"__e_{n}") for n, e in edge.items()))
        return edges.select(F.col(_PART).alias("__p"), *(F.col(k).alias(f"__k_{k}") for k in self.keys), *(f.alias(f"__f_{n}") for n, f in far.items()))


def carried(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None, **wanted: tuple[str, Column]) -> DataFrame:
    """``rows`` with a column for each of ``wanted``, a kind and what it is made from.

    ``before``: the last value that is not null among earlier rows of the key; ``after``: the first among later ones;
    ``total``: the sum over earlier ones, 0 at first. ``order`` must tell a key's rows apart, else equal ones come in any
    order. A null key is a key. Rows are dealt once, into ``parts`` (the session's shuffle partitions).
    """
    return Dealt(rows, keys, order, parts).carry(**wanted).rows.select(*rows.columns, *wanted)
