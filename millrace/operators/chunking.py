"""Recursive splitting of texts into overlapping chunks: one row in, many rows out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SEPARATORS = ("\n\n", "\n", ". ", "。", "; ", "；", " ", "")

#: Characters whose chunks a task holds before it hands them on.
HELD = 1 << 21


def split(text: str, size: int = 600, overlap: int = 150, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that serves; neighbours share up to ``overlap``."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, finer = separators[at], separators[at + 1 :]
    if sep == "":
        parts = [text[i : i + size] for i in range(0, len(text), size)]
    else:
        raw = text.split(sep)
        parts = [raw[0], *(sep + p for p in raw[1:])]  # a separator stays with what follows it
    out: list[str] = []
    window: list[str] = []
    length = 0

    def flush() -> None:
        joined = "".join(window).strip()
        if joined:
            out.append(joined)

    for part in filter(None, parts):
        if len(part) > size:
            flush()
            window, length = [], 0
            out += split(part, size, overlap, finer)
            continue
        if length + len(part) > size:
            flush()
            while window and (length > overlap or length + len(part) > size):
                length -= len(window.pop(0))
        window.append(part)
        length += len(part)
    flush()
    return out


def split_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 600, overlap: int = 150) -> DataFrame:
    """(id, chunk_index, content); null and blank texts have no chunks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for pdf in frames:
            for d, t in zip(pdf[id_col], pdf[text_col]):
                if not t:
                    continue
                rows += [(d, i, c) for i, c in enumerate(split(t, size, overlap))]
                held += len(t)
                if held >= HELD:
                    yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "content"])
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "content"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} long, chunk_index int, content string")
