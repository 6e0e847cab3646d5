"""Removal of repeated word windows, by levels of doubled length.

A long window is one of ``width`` words. At the first level each long window is looked at through its short one: of the
windows of 8 words in it, that of the least hash. Equal long windows agree on theirs, so a long window can repeat only
where its short one does, and about one short window in fifteen is anyone's. Only what repeats at one length goes on to
twice that length: 8 words, then 16, 32 and so on while that is less than ``width``, and at last ``width`` itself, until
no candidates survive. A window is extended to the right, or, where its long window ends before that, to the left for
what is missing; that too is the same in equal long windows.

Copies are settled early: consecutive long windows with one short window are a run, and a run whose words repeat as a
whole repeats in all its windows. Only where one short window has several different runs, one copy of each run, with the
number of its copies, goes through the further levels. Their hashes are made in one pass over these texts, and each level
counts the survivors of the one before.

Windows are keyed by two hashes of 64 bits (short window, extended window). Equal windows are counted where they are
found before they meet, joins are keyed by both hashes, and nothing is gathered by window, so one passage that fills a
third of the corpus is one row in every count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words
from millrace.llm.shared import drop_staged, staged

#: Words of the windows of the first level (less where ``width`` is).
ANCHOR = 8
_KEY = ["__id", "__h"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row's key is its id and its text's hash: rows with equal ids and other texts stay apart."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("__id"), F.xxhash64(text_col).alias("__h"), F.col(text_col).alias("__text"))


def lengths(width: int) -> list[int]:
    """Window lengths level by level: powers of two from 8 (or the last that ``width`` holds) on, and ``width``."""
    out = [1]
    while out[-1] * 2 <= min(ANCHOR, width):
        out[-1] *= 2
    while out[-1] * 2 < width:
        out.append(out[-1] * 2)
    return [*out, width]


def anchors(w: words.Words, width: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive long windows with one short window: text, its hash, the run's hash, the first long window's
    place in the text, how far behind that the short window begins, and the number of long windows."""
    n, short = len(w.hashes), lengths(width)[0]
    start = np.flatnonzero(w.room()[: max(0, n - width + 1)] >= width)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h, size = w.hashes, 1
    while size < short:
        h = words.combine(h[:-size], h[size:])
        size *= 2
    bits = max(20, int(n).bit_length())
    low = np.uint64(2**bits - 1)
    least, span, want = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, width - short + 1
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    at = (least[start] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    runs = np.diff(np.concatenate([new, [len(start)]]))
    first = start[new]
    text = np.searchsorted(w.first, first, side="right") - 1
    whole = words.spans(w.hashes, first, first + runs + width - 1)
    return text, h[at[new]].view(np.int64), whole.view(np.int64), first - w.first[text], at[new] - first, runs


_RUNS = "__id long, __h long, anchor long, span long, start int, lead int, n int"


def _runs(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in words.of(batches, 2):
            text, anchor, span, *numbers = anchors(w, width)
            ids, hashes = (batch.column(i).to_numpy() for i in (0, 1))
            columns = [ids[text], hashes[text], anchor, span, *(c.astype(np.int32) for c in numbers)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["__id", "__h", "anchor", "span", "start", "lead", "n"])

    return run


def _further(width: int) -> list[int]:
    """The lengths after the first level's."""
    return lengths(width)[1:]


def _extended_schema(width: int) -> str:
    return "__id long, __h long, anchor long, start int, copies long, " + ", ".join(f"h{m} long, new{m} boolean" for m in _further(width))


def _extended(width: int):
    """The long windows of the runs that a row names (start, lead, n, anchor, copies), each with its extended windows.

    ``h16``: the hash of the window of 16 words; ``new16``: this row is the first in its run with that window. A row
    listed often is one here: the join before brings its copies to one task, or to few where it is split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in words.of(words.once(batches, 0, 1), 2):
            runs = batch.column(3)
            flat, listed = runs.flatten(), np.diff(runs.offsets.to_numpy())
            text = np.repeat(np.arange(batch.num_rows), listed)
            start, lead, n, anchor, copies = (flat.field(i).to_numpy() for i in range(5))
            row = np.repeat(np.arange(len(n)), n)
            opens = np.repeat(np.cumsum(n) - n, n)
            within = start[row] + np.arange(len(row)) - opens
            base = w.first[text[row]]
            at, first, levels = start[row] + lead[row], np.arange(len(row)) == opens, []
            for m in _further(width):
                at = np.minimum(at, within + width - m)
                new = first | np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]
                levels += [words.spans(w.hashes, base + at, base + at + m).view(np.int64), new]
            ids, hashes = (batch.column(i).to_numpy() for i in (0, 1))
            columns = [ids[text[row]], hashes[text[row]], anchor[row], within.astype(np.int32), copies[row], *levels]
            names = ["__id", "__h", "anchor", "start", "copies", *(x for m in _further(width) for x in (f"h{m}", f"new{m}"))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


def repeated_runs(keyed: DataFrame, width: int) -> DataFrame:
    """Staged __id, __h, start, n: the starts of windows of ``width`` words whose words also start elsewhere."""
    level1 = staged(keyed.mapInArrow(_runs(width), _RUNS), "anchors")
    spans = level1.groupBy("anchor", "span").agg(F.count("*").alias("copies"))
    spans = staged(spans, "spans")
    totals = spans.groupBy("anchor").agg(F.sum("copies").alias("total"), F.count("*").alias("spans")).where("total > 1")
    alive = spans.join(totals, "anchor").select(F.col("anchor").alias("__a"), F.col("span").alias("__s"), "copies", (F.col("spans") > 1).alias("mixed"))
    found = staged(
        level1.join(alive, (F.col("anchor") == F.col("__a")) & (F.col("span") == F.col("__s"))).select(
            *_KEY, "anchor", "span", "start", "lead", "n", "copies", "mixed"
        ),
        "repeats",
    )
    drop_staged(level1, spans)
    one = F.min(F.struct(*_KEY, "start", "lead", "n", "copies")).alias("r")
    chosen = found.where("mixed").groupBy("anchor", "span").agg(one).select("r.*", "anchor")
    listed = chosen.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "lead", "n", "anchor", "copies")).alias("__runs"))
    settled = found.where("copies > 1").select(*_KEY, "start", "n")
    rows = staged(keyed.join(listed, _KEY).select(*_KEY, "__text", "__runs").mapInArrow(_extended(width), _extended_schema(width)), "extended")
    for m in _further(width):
        if rows.isEmpty():
            break
        kept = [c for c in rows.columns if c not in (f"h{m}", f"new{m}")]
        again = rows.groupBy("anchor", f"h{m}").agg(F.sum(F.when(F.col(f"new{m}"), F.col("copies"))).alias("total")).where("total > 1")
        left = rows.join(again.select("anchor", f"h{m}"), ["anchor", f"h{m}"], "left_semi").select(*kept)
        left = staged(left, f"level{m}")
        drop_staged(rows)
        rows = left
    out = staged(settled.unionByName(rows.where("copies = 1").select(*_KEY, "start", F.lit(1).alias("n"))), "removed")
    drop_staged(found, rows)
    return out


_DONE = "__id long, n_words long, n_removed long, kept string"


def _kept(raw_words: int, starts: np.ndarray, runs: np.ndarray, width: int) -> np.ndarray:
    """Which words no window of the runs covers."""
    edge = np.zeros(raw_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + runs + width - 1, -1)
    return np.cumsum(edge)[:-1] == 0


def _keep(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in words.slices(batch, 1):
                rows = []
                listed = [batch.column(i).slice(at, len(texts)) for i in (2, 3)]
                for i, raw in enumerate(texts):
                    parts = raw.split()
                    keep = None
                    if listed[0][i].is_valid:
                        keep = _kept(len(parts), *(np.array(c[i].values, np.int64) for c in listed), width)
                    kept = parts if keep is None else [p for p, k in zip(parts, keep) if k]
                    rows.append((len(parts), len(parts) - len(kept), b" ".join(kept)))
                n, removed, kept = zip(*rows)
                columns = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], ["__id", "n_words", "n_removed", "kept"])

    return run


def _without(raw: bytes, keep: np.ndarray) -> bytes:
    """The text without its dropped words and the white space after them."""
    w = words.Words([raw])
    ends = np.append(w.start[1:], len(raw))
    return raw[: w.start[0]] + b"".join([raw[s:e] for s, e, k in zip(w.start, ends, keep) if k])


def _listed(keyed: DataFrame, width: int) -> DataFrame:
    """The runs of each row's key, once each however often the row is listed; a text's runs are no more than its words."""
    runs = repeated_runs(keyed, width).groupBy(*_KEY).agg(F.collect_set(F.struct("start", "n")).alias("__r"))
    return runs.select(*_KEY, F.col("__r.start").alias("__starts"), F.col("__r.n").alias("__runs"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 35) -> DataFrame:
    """id, n_words, n_removed and kept (the words left, joined by one space) of every row of ``docs``.

    A word goes if some window of ``width`` consecutive words covers it whose words also start anywhere else in
    ``docs``, in the same document too; all copies go, judged on the input. Null, empty and short texts have no windows.
    Repeated rows are copies of each other. A null id stays null. Other columns are not read. No rows give no rows.
    """
    keyed = _keyed(docs, id_col, text_col)
    done = keyed.join(_listed(keyed, width), _KEY, "left").select("__id", "__text", "__starts", "__runs").mapInArrow(_keep(width), _DONE)
    return done.select(F.when(F.col("__id") != -(2**63), F.col("__id")).alias(id_col), "n_words", "n_removed", "kept")


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """The rows of ``docs`` with repeated windows cut out of their texts, and all white space elsewhere as it was.

    The same words go as by :func:`remove_repeats`; texts without any are unchanged, null ones stay null.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for text, s, r in zip(texts, starts, runs):
            if s is None or text is None:
                out.append(text)
            else:
                raw = text.encode()
                out.append(_without(raw, _kept(len(raw.split()), np.asarray(s, np.int64), np.asarray(r, np.int64), width)).decode())
        return pd.Series(out, dtype=object)

    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("__id"), F.xxhash64(text_col).alias("__h"))
    rows = rows.join(_listed(_keyed(docs, id_col, text_col), width), _KEY, "left")
    new = cut(F.col("row")[text_col], F.col("__starts"), F.col("__runs"))
    return rows.select(F.col("row").withField(f"`{text_col}`", new).alias("row")).select("row.*")
