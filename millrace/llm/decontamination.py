"""Benchmark decontamination by pigeonhole edit matching over words.

An item with an error budget of e word edits is cut into e + 1 pieces: a passage within the budget holds at least one of
them unchanged. All pieces are found by one Aho-Corasick pass over a document's normalised words; around each hit Myers'
bit-parallel algorithm gives the least number of word insertions, deletions and substitutions that turn the item into a
passage there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import drop_staged, staged

_GAPS = re.compile(r"[\W_]+").sub


def normal(text: str) -> str:
    """Lower-case runs of letters and digits, each between single spaces."""
    return " " + _GAPS(" ", text.lower()).strip() + " "


def budget(n_words: int, share: float) -> int:
    """Edits allowed for an item: ``share`` of its words, at least one from 8 words on, none below."""
    return max(1, int(n_words * share)) if n_words >= 8 else 0


def pieces(item: list[str], errors: int) -> list[tuple[int, str]]:
    """The item cut into ``errors`` + 1 runs of words, as even as can be: where each begins, and its text."""
    n, k = len(item), errors + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, " " + " ".join(item[a:b]) + " ") for a, b in zip(cuts, cuts[1:])]


def myers(pattern: list[str], text: list[str], most: int) -> tuple[int, int] | None:
    """The least edit distance, at most ``most``, of ``pattern`` to a run of ``text``, and where the first such run ends.

    Vertical differences of one column of the table are two bit vectors; Python's integers hold any pattern.
    """
    m = len(pattern)
    if not m:
        return None
    places: dict[str, int] = {}
    for i, w in enumerate(pattern):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, best = full, 0, m, (m, 0) if m <= most else None
    for at, w in enumerate(text):
        same = places.get(w, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        more, less = down | ~(diagonal | up) & full, up & diagonal
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = more << 1 & full, less << 1 & full
        up, down = less | ~(diagonal | more) & full, more & diagonal
        if score <= most and (best is None or score < best[0]):
            best = score, at + 1
    return best


class Matcher:
    """Finds in a text the items that it holds within their budgets."""

    def __init__(self, items: dict[int, list[str]], share: float):
        self.items = {i: ws for i, ws in items.items() if ws}
        self.budgets = {i: budget(len(ws), share) for i, ws in self.items.items()}
        of: dict[str, list[tuple[int, int]]] = {}
        for item, ws in self.items.items():
            for begins, piece in pieces(ws, self.budgets[item]):
                of.setdefault(piece, []).append((item, begins))
        self.found = ahocorasick.Automaton()
        for piece, users in of.items():
            self.found.add_word(piece, (len(piece), users))
        self.found.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """item -> its least distance and the place after that passage among the normalised words."""
        best: dict[int, tuple[int, int]] = {}
        flat = normal(text)
        if not self.items:
            return best
        hits = [(end - length + 1, users) for end, (length, users) in self.found.iter(flat)]
        if not hits:
            return best
        ws, tried, before, at = flat.split(), set(), 0, 0
        for start, users in sorted(hits, key=lambda h: h[0]):
            before += flat.count(" ", at, start)
            at = start
            for item, begins in users:
                e, first = self.budgets[item], before - begins
                if (item, first) in tried:
                    continue
                tried.add((item, first))
                low = max(0, first - e)
                got = myers(self.items[item], ws[low : max(0, first + len(self.items[item]) + e)], e)
                if got and (item not in best or (got[0], low + got[1]) < best[item]):
                    best[item] = got[0], low + got[1]
        return best


_HIT = "array<struct<item_id:long,distance:int,end_word:long,n_words:long>>"


def held(text: Column, items: list[tuple[int | None, list[str]]], share: float) -> Column:
    """The items, each an id and words, that each text of a column holds. Items are told apart by their place in the list."""

    @F.pandas_udf(_HIT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher({k: ws for k, (_, ws) in enumerate(items)}, share)
        for texts in batches:
            found = [matcher.find(t or "") for t in texts]
            yield pd.Series([[dict(item_id=items[k][0], distance=d, end_word=e, n_words=len(items[k][1])) for k, (d, e) in f.items()] for f in found])

    return run(text)


def blocks(benchmark: DataFrame, item_col: str, item_text: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[int | None, list[str]]]]]:
    """The number of blocks, at least one, of about ``block_bytes`` of text; and each block's items' ids and words.

    A block is collected when it is asked for. Repeated items come once.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    n = max(1, -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))

    def words() -> Iterator[list[tuple[int, list[str]]]]:
        for block in range(n):
            rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == block).distinct().collect()
            yield [(r["i"], normal(r["t"]).split()) for r in rows]

    return n, words()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", share: float = 0.1, block_bytes: int = 16 << 20,
) -> DataFrame:
    """id, item_id, distance, end_word, n_words: one row for each document and item that it holds within its budget.

    Of several passages the nearest, then the first counts; ``end_word`` is the place after it among the document's
    normalised words. Null or wordless texts and items match nothing; items under 8 words match unchanged only; equal
    items are reported each, also those with equal ids and other texts; equal items with equal ids are one item.
    Repeated rows are reported each. Items with a null id are items as any other, reported with it. Other columns are not read.
    An empty table on either side gives no rows. Items go to tasks in blocks of about ``block_bytes`` of text, as many
    as the benchmark needs by its measured size; of several, each one's hits are written before the next is collected,
    so what is held and sent at once does not grow with it.
    """
    out = None
    n, words = blocks(benchmark, item_col, item_text, block_bytes)
    for items in words:
        hits = docs.select(F.col(id_col).alias("__id"), F.inline(held(F.col(text_col), items, share)))
        if n > 1:
            hits = staged(hits, "hits")
        out = hits if out is None else out.unionByName(hits)
    return out.withColumnRenamed("__id", id_col)


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    share: float = 0.1, block_bytes: int = 16 << 20,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, as they are. Rules as for :func:`contaminated`."""
    n, words = blocks(benchmark, item_col, item_text, block_bytes)
    last = None
    for items in words:
        rows = docs.select(F.struct("*").alias("row"), held(F.col(text_col), items, share).alias("held"))
        docs = rows.where(F.size("held") == 0).select("row.*")
        if n > 1:
            docs = staged(docs, "clean")
            if last is not None:
                drop_staged(last)
            last = docs
    return docs
