"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, takes compatibility forms (full-width, mathematical, circled letters) and letters with marks apart,
drops marks and characters without width, maps look-alike letters of other scripts to Latin ones and digits and signs that
stand for letters to these, and turns everything else that is no letter into one space. Terms are whole words
(`` word ``) or beginnings of words (`` beg``). A word counts once, with its heaviest term; words inside of an exception
phrase do not count. The sum is divided by the logarithm of the length, and one threshold maps it to a score.

The lexicon's words here are a seed; weights, further terms and the threshold are learned from labelled rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import drop_staged, let_go, staged

SEED = dict.fromkeys(("idiot", "moron", "scum", "loser", "stupid", "worthless", "pathetic", "disgusting", "imbecile", "vermin"), 4.0)
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "clown fish", "clown school", "disgusting taste", "pathetic fallacy", "sore loser")

#: Look-alikes of Latin letters that are no compatibility forms, then digits and signs that stand for letters.
_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ԁ": "d", "к": "k", "м": "m", "т": "t", "ј": "j", "һ": "h",
    "ԛ": "q", "ԝ": "w", "п": "n", "г": "r", "в": "b", "н": "h", "ү": "y", "ӏ": "l", "ё": "e", "є": "e", "ο": "o", "α": "a", "ε": "e", "ι": "i", "ν": "v",
    "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "η": "n", "χ": "x", "γ": "y", "σ": "o", "ω": "w", "β": "b", "ց": "g", "օ": "o", "ս": "u", "հ": "h", "ո": "n",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʏ": "y", "ɪ": "i", "ø": "o", "đ": "d", "ħ": "h", "ł": "l", "ŧ": "t", "ƒ": "f", "æ": "ae", "œ": "oe", "ß": "ss",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l",
}
_FOLD = str.maketrans(_ALIKE)
#: Marks and characters without width: what is left of a letter once its marks are apart, and what may stand inside of words unseen.
_UNSEEN = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+").sub
#: Signs that stand for a letter between letters only.
_INSIDE = re.compile(r"(?<=[^\W_])[!|](?=[^\W_])").sub
_GAPS = re.compile(r"[\W\d_]+").sub
#: Lengths of word beginnings that may become terms.
BEGINNINGS = (4, 5, 6)


def fold(text: str) -> str:
    """Folded words, each between single spaces."""
    if not text.isascii():
        text = _UNSEEN("", unicodedata.normalize("NFKD", text))
    return " " + _GAPS(" ", _INSIDE("i", text.lower()).translate(_FOLD)).strip() + " "


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]  # " word " or " beg" -> weight
    exceptions: tuple[str, ...]
    threshold: float


def matcher(model: Model) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in model.terms.items():
        found.add_word(term, (len(term), weight))
    for phrase in model.exceptions:
        found.add_word(fold(phrase), (len(fold(phrase)), None))
    found.make_automaton()
    return found


def weigh(found: ahocorasick.Automaton, folded: str) -> tuple[float, int]:
    """The weights of a folded text's matched words, summed, and how many there are."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight) in found.iter(folded):
        start = end - length + 1
        if weight is None:
            spared.append((start, end))
        elif weight > best.get(start, 0):
            best[start] = weight
    if spared and best:
        for a, b in spared:
            for start in [s for s in best if a <= s < b]:
                del best[start]
    return sum(best.values()), len(best)


def weighed(text: Column, model: Model) -> Column:
    """struct(weight, hits, n_words) of a text column."""

    @F.arrow_udf("weight double, hits int, n_words long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        found = matcher(model)
        for texts in batches:
            rows: tuple[list, ...] = ([], [], [])
            for at in range(0, len(texts), 256):  # few texts at a time are Python strings
                for text in texts.slice(at, 256).to_pylist():
                    folded = fold(text or "")
                    for column, value in zip(rows, (*weigh(found, folded), max(0, folded.count(" ") - 1))):
                        column.append(value)
            kinds = (pa.float64(), pa.int32(), pa.int64())
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["weight", "hits", "n_words"])

    return run(text)


def level(weighed_text: Column) -> Column:
    """The weight for its length."""
    return weighed_text["weight"] / (1 + F.log1p(weighed_text["n_words"] / 50))


def score_of(weighed_text: Column, model: Model) -> Column:
    """0 without any match, 0.3 at the threshold, below 1."""
    return 1 - F.pow(F.lit(0.7), level(weighed_text) / model.threshold)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of a text's word triples: copies and most near copies share it."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, signs = batch.slice(at, 256), []
            for text in part.column(1).to_pylist():
                ws = (text or "").lower().split()
                signs.append(min(xxhash.xxh3_64_intdigest(" ".join(ws[i : i + 3])) for i in range(max(1, len(ws) - 2))) >> 1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(signs, pa.int64())], ["label", "text", "sign"])


def _terms(text: str) -> set[str]:
    out: set[str] = set()
    for word in set(fold(text).split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in BEGINNINGS if len(word) >= n)
    return out


def _counted(only: frozenset[str] | None):
    """Counts of terms by label, summed for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(at, 256).to_pylist():
                    terms = _terms(text or "")
                    counts.update(terms if only is None else terms & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return run


def fit(
    labelled: DataFrame, *, label: str, text: str, least_share: float = 0.02, least_weight: float = 2.5,
    seed: dict[str, float] = SEED, exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Model:
    """Learns term weights and the threshold from labelled rows, as :func:`labelled_sample` bounds them.

    The bound keeps fitting the same work at any size of the corpus; scoring covers every row. Of copies (rows of one
    label that share their least hash of word triples) the least text counts, so the model follows from the rows alone. A
    term needs ``least_share`` of the toxic rows and a log odds ratio of ``least_weight``; that leaves at most 1 /
    ``least_share`` times the terms of a mean toxic row to look at, and none of those that weigh enough is left out.
    Null texts are empty; rows without a label are left out. Without toxic or without clean rows the seed alone is the lexicon.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("label"), F.col(text).alias("text"))
    rows = rows.mapInArrow(_signed, "label int, text string, sign long").groupBy("label", "sign").agg(F.min("text").alias("text"))
    rows = staged(rows.select("label", "text", "sign"), "labelled")
    try:
        sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        bad, good = sizes.get(1, 0), sizes.get(0, 0)
        terms = {f" {fold(w).strip()} ": v for w, v in seed.items()}
        if not bad or not good:
            return Model(terms, exceptions, 1.0)
        least = max(3, least_share * bad)
        summed = lambda y, only: rows.where(F.col("label") == y).mapInArrow(_counted(only), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        often = {r["term"]: r["n"] for r in summed(1, None).where(F.col("n") >= least).collect()}
        clean = {r["term"]: r["n"] for r in summed(0, frozenset(often)).collect()}
        weight = {t: float(np.log((n + 0.5) / (bad + 1)) - np.log((clean.get(t, 0) + 0.5) / (good + 1))) for t, n in often.items()}
        terms |= {t: w for t, w in sorted(weight.items()) if w >= least_weight}
        model = Model(terms, exceptions, 1.0)
        levels = rows.select("label", weighed(F.col("text"), model).alias("w")).select("label", F.floor(level(F.col("w")) * 8).alias("bin"))
        bins = levels.groupBy("bin", "label").count().collect()
        return Model(terms, exceptions, threshold({(r["bin"], r["label"]): r["count"] for r in bins}))
    finally:
        drop_staged(rows)


def threshold(counts: dict[tuple[int, int], int]) -> float:
    """The level of best F1 by eighths of a level; of equally good ones, a third of the way up from the lowest."""
    bad = sum(n for (_, y), n in counts.items() if y == 1)
    best, at = -1.0, [1]
    for cut in range(1, max(b for b, _ in counts) + 2):
        hit = sum(n for (b, y), n in counts.items() if b >= cut and y == 1)
        wrong = sum(n for (b, y), n in counts.items() if b >= cut and y == 0)
        f1 = 2 * hit / max(1, hit + wrong + bad)
        if f1 > best + 1e-12:
            best, at = f1, [cut]
        elif f1 > best - 1e-12:
            at.append(cut)
    return at[len(at) // 3] / 8


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hits, n_words and score of every row: 0 without any match, 0.3 at the threshold, below 1.

    Null and empty texts score 0; repeated rows score alike; other columns are not read; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("__id"), weighed(F.col(text_col), model).alias("__w"))
    return rows.select(F.col("__id").alias(id_col), "__w.hits", "__w.n_words", score_of(F.col("__w"), model).alias("score"))


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", most: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``most``, as they are. Null and empty texts score 0 and stay; repeated rows
    go or stay together; columns may have any names; no rows give no rows."""
    rows = docs.select(F.struct("*").alias("row"), weighed(F.col(text_col), model).alias("w"))
    return rows.where(score_of(F.col("w"), model) < most).select("row.*")


def labelled_sample(docs: DataFrame, labels: DataFrame, *, label: str, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 12_000) -> DataFrame:
    """(label, text) of about ``most_rows`` labelled documents, chosen by their id's hash.

    Ids with several labels count once for each. Null ids are left out, null texts come as they are, and a text that is
    listed several times with one label comes once, so rows that are repeated don't outgrow the bound.
    """
    chosen = labels.select(F.col(id_col).alias("__l"), F.col(label).alias("label")).where(F.col("__l").isNotNull()).distinct()
    n = chosen.count()
    if n > most_rows:
        chosen = chosen.where(F.pmod(F.xxhash64("__l"), F.lit(1 << 20)) < int(most_rows / n * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("__d"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("__d") == F.col("__l")).select("label", "text").distinct()


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
