"""Quality by votes of the nearest labelled documents in a latent space.

A text's terms are the shapes of its characters (letters, capitals, digits, white space, each sign its own), runs of one
shape being one, taken three at a time. Log counts weighted by inverse document frequency are projected on the first axes
of a singular value decomposition of a bounded sample of labelled documents; beside these latent values stand a few
measures of repetition. The labelled vectors are broadcast. Each task multiplies blocks of its documents' vectors with all
of them, so cosines are exact, and the most similar vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words

#: Hashed terms, latent axes, measures of repetition.
TERMS, AXES, MEASURES = 2048, 64, 5
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
#: Shapes of bytes: 0 stands before and after a text, 1 lower, 2 capital, 3 digit, 4 beyond ASCII, 5 blank, 6 line end, 7 other, then signs.
_SHAPE = np.full(256, 7, np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:], _SHAPE[[32, 9]], _SHAPE[[10, 13]] = 1, 2, 3, 4, 5, 6
_SHAPE[_SIGNS] = np.arange(8, 8 + len(_SIGNS))
_TERM = (words.mix(np.arange(2**18, dtype=np.uint64) + np.uint64(1)) % np.uint64(TERMS)).astype(np.int32)


def shapes(raw: bytes) -> np.ndarray:
    """Counts of a text's hashed terms."""
    s = _SHAPE[np.frombuffer(raw, np.uint8)]
    if len(s):
        s = s[np.concatenate([[True], s[1:] != s[:-1]])]
    s = np.concatenate([[0, 0], s, [0, 0]]).astype(np.int32)
    return np.bincount(_TERM[s[:-2] << 12 | s[1:-1] << 6 | s[2:]], minlength=TERMS) if len(raw) else np.zeros(TERMS, np.int64)


def repetition(hashes: np.ndarray) -> list[float]:
    """From a text's word hashes: distinct words for the length, the most frequent word's share, words equal to the one
    before, and to the two before; and one, for length."""
    n = len(hashes)
    if not n:
        return [0.0] * MEASURES
    counts = np.unique(hashes, return_counts=True)[1]
    again = lambda k: float((hashes[k:] == hashes[:-k]).mean()) if n > k else 0.0
    return [len(counts) / n**0.75, counts.max() / n if n >= 20 else 0.0, again(1), again(2), min(1.0, n / 100)]


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Term counts and measures of some texts."""
    w = words.Words(texts, lower=True)
    parts = np.split(w.hashes, w.first[1:-1]) if len(texts) else []
    return np.array([shapes(t) for t in texts], np.float32).reshape(-1, TERMS), np.array([repetition(h) for h in parts], np.float32).reshape(-1, MEASURES)


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # of each term
    axes: np.ndarray
    vectors: np.ndarray  # of the labelled documents, of length one
    labels: np.ndarray
    neighbours: int
    prior: float  # the labelled documents' share of label 1

    def place(self, counts: np.ndarray, measures: np.ndarray, share: float = 0.3) -> np.ndarray:
        """Unit vectors; a text without any character has none but noughts."""
        t = np.log1p(counts) * self.weight
        t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-9)
        z = np.hstack([t @ self.axes, share * measures])
        return (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def votes(self, vectors: np.ndarray) -> np.ndarray:
        """The share of label 1 among the neighbours by the eighth power of their cosines; those level with the last count too."""
        if not len(self.vectors):
            return np.full(len(vectors), self.prior)
        near = np.round(vectors @ self.vectors.T, 5)
        k = min(self.neighbours, near.shape[1])
        last = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        w = np.where(near >= last, np.maximum(near, 0), 0).astype(np.float64) ** 8
        total = w.sum(axis=1)
        return np.where(total > 1e-12, (w @ self.labels) / np.maximum(total, 1e-12), self.prior)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, label: str, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 4_000) -> DataFrame:
    """(label, text) of at most ``most_rows`` labelled documents: those whose ids have the least hashes.

    Null ids and null labels are left out. An id with several labels or several texts has its least label and its least
    text, null counting as empty, so a row that is repeated counts once. Labels of absent documents give nothing.
    """
    chosen = labels.select(F.col(id_col).alias("__l"), F.col(label).cast("int").alias("label")).where("__l IS NOT NULL AND label IS NOT NULL")
    chosen = chosen.groupBy("__l").agg(F.min("label").alias("label")).orderBy(F.xxhash64("__l"), "__l").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("__d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("__d") == F.col("__l"))
    return found.groupBy("__l", "label").agg(F.min("text").alias("text")).select("label", "text")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in words.slices(batch, 1):
            counts, measures = counted(texts)
            part = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (counts, measures)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *part], ["label", "counts", "measures"])


def fit(labelled: DataFrame, *, neighbours: int = 15, axes: int = AXES) -> Model:
    """The model of a bounded labelled sample (label, text), as :func:`labelled_sample` gives it.

    The driver holds the sample's term counts, ``TERMS`` numbers for each row. Without rows every score is 0.5; with one
    label alone every score is that label.
    """
    rows = labelled.select("label", "text").mapInArrow(_features, "label int, counts binary, measures binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["counts"]), bytes(r["measures"])))
    counts = np.array([np.frombuffer(r["counts"], np.float32) for r in rows], np.float32).reshape(-1, TERMS)
    measures = np.array([np.frombuffer(r["measures"], np.float32) for r in rows], np.float32).reshape(-1, MEASURES)
    labels = np.array([r["label"] for r in rows], np.float64)
    n = len(rows)
    weight = (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    t = np.log1p(counts) * weight
    t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-9)
    _, u = np.linalg.eigh((t.T @ t).astype(np.float64)) if n else (None, np.eye(TERMS))
    model = Model(weight, np.ascontiguousarray(u[:, ::-1][:, :axes], np.float32), np.zeros((0, axes + MEASURES), np.float32), labels, neighbours, float(labels.mean()) if n else 0.5)
    return Model(weight, model.axes, model.place(counts, measures), labels, neighbours, model.prior)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, higher: label 1 likelier) of every row.

    Null and empty texts have no vector and score the labelled sample's share of label 1. Repeated rows score alike,
    however rows are dealt. Other columns, whatever their names, are not read; no rows give no rows.
    """
    return docs.select(F.col(id_col).alias("__id"), scored(F.col(text_col), model).alias("score")).withColumnRenamed("__id", id_col)


def scored(text: Column, model: Model) -> Column:
    shared = _spark().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            batch, out = pa.RecordBatch.from_arrays([texts], ["text"]), []
            for _, raws in words.slices(batch, 0):
                for at in range(0, len(raws), 256):
                    out.append(m.votes(m.place(*counted(raws[at : at + 256]))))
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    return run(text)


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def held_out(id_col: str = "doc_id", of: int = 3, rest: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` when divided by ``of``. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(of)) == rest
