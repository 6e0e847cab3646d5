"""Bounded-space online best-fit packing of token sequences.

A packer holds a fixed number of open bins, found by their free space in a bitset: the lowest set bit at or above an
item's length is the tightest bin it fits. Where none fits, a new bin opens; where all are open, the fullest closes
first. Packers run side by side, each over its own share of the pieces, so no task grows with the corpus; the price is
the few bins that each share leaves open, which ``share`` makes negligible.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import tokens
from millrace.llm.shared import staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Online best-fit into bins of ``capacity`` with at most ``most_open`` of them open."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.levels: list[list[int]] = [[] for _ in range(capacity + 1)]  # free space -> open bins
        self.bits = 0  # bit f is set where levels[f] has a bin
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        at = self.levels[free].pop()
        if not self.levels[free]:
            self.bits ^= 1 << free
        return at

    def place(self, length: int) -> tuple[int, int]:
        """The bin of an item and its offset there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            at = self._take(free)
        else:
            if self.open == self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
                self.open -= 1
            at, free = self.made, self.capacity
            self.made += 1
            self.open += 1
        left = free - length
        if left:
            self.levels[left].append(at)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return at, self.capacity - free


def pack(
    pieces: DataFrame, length: str = "length", *, capacity: int = 2048, most_open: int = 4096, block: int = 4096,
    share: int = 32_768,
) -> DataFrame:
    """Adds sequence_id and offset to a staged table of pieces with lengths from 1 to ``capacity``.

    Full pieces are sequences of their own. The rest is dealt by row number into shares of about ``share`` pieces. A
    share arrives in blocks of ``block`` pieces, each sorted from long to short, as best-fit wastes least that way; with
    ``most_open`` no less than ``block``, short pieces of a block still find the bins that its long ones opened.
    Null or longer lengths are an error; equal lengths and repeated rows are packed like others; no rows give no rows.
    Columns named sequence_id, offset, __row or __share would clash with what is added and are an error.
    """
    if clash := {"sequence_id", "offset", "__row", "__share"} & set(pieces.columns):
        raise ValueError(f"columns {sorted(clash)} are added here")
    numbered = pieces.withColumn("__row", F.monotonically_increasing_id())
    full = numbered.where(F.col(length) == capacity).select(
        *pieces.columns, (F.col("__row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = numbered.where(F.col(length).isNull() | (F.col(length) != capacity))
    shares = max(1, round(rest.count() / share))
    out = full.schema
    width = capacity

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__row", kind="stable")
        fit, bins, offsets = BestFit(width, most_open), {}, {}
        for at in range(0, len(pdf), block):
            part = pdf.iloc[at : at + block].sort_values([length, "__row"], ascending=[False, True])
            for row, n in zip(part["__row"], part[length]):
                if not 0 < n < width:
                    raise ValueError(f"a piece of {n} tokens cannot be packed into {width}")
                bins[row], offsets[row] = fit.place(int(n))
        pdf["sequence_id"] = [((int(key[0]) << 32) + bins[r]) * 2 for r in pdf["__row"]]
        pdf["offset"] = [offsets[r] for r in pdf["__row"]]
        return pdf[out.names]

    dealt = rest.withColumn("__share", F.pmod(F.xxhash64("__row"), F.lit(shares)).cast("int"))
    return full.unionByName(dealt.groupBy("__share").applyInPandas(packed, out))


def token_pieces(docs: DataFrame, vocabulary: str, *, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Encodes doc_id and text, appends ``end_id`` and cuts only what is longer than ``capacity``: one row a piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, width = end_id.to_bytes(4, "little"), 4 * capacity
        for part, texts in tokens.encoded(batches, vocabulary):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(part.column(0).to_pylist(), texts):
                ids = text.tobytes() + end
                for k, at in enumerate(range(0, len(ids), width)):
                    one = ids[at : at + width]
                    for column, value in zip(rows, (doc, k, at // 4, len(one) // 4, zlib.crc32(one))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """Every document of ``docs`` packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, the end id. A null doc_id stays null; repeated rows are packed once each. Other
    columns are not read. Texts are encoded where they are scanned; only the pieces' numbers are written and dealt.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return pack(staged(token_pieces(slim, vocabulary, capacity=capacity), "pieces"), capacity=capacity)
