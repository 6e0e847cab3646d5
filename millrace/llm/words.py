"""Words of whole texts as arrays of 64-bit hashes, many documents at a time.

A word of up to 64 bytes is mixed eight bytes at a time, one of up to eight bytes without loss; a longer one has a
cryptographic hash. Runs of words are hashed by doubling: the hash of 2**k words mixes those of its halves. Each step is
non-linear, so no words or runs collide by their structure, as all polynomials modulo a power of two do on some.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.llm.shared import let_go

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP, _SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA24BAED4963EE407)
#: Bytes of words that are mixed here.
_SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes, in order."""
    return mix(a * _STEP + b)


def _hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each run of bytes."""
    size = end - start
    out = size.astype(np.uint64) * _SIZE
    lanes = np.ndarray((len(raw) + 1,), "<u8", raw.tobytes() + bytes(8), strides=(1,))  # eight bytes from each place on
    left = np.arange(len(start))
    for at in range(0, _SHORT, 8):
        rest = size[left] - at
        lane = lanes[start[left] + at]
        few = np.flatnonzero(rest < 8)
        lane[few] &= (np.uint64(1) << (rest[few] * 8).astype(np.uint64)) - np.uint64(1)
        out[left] = mix(out[left] * _STEP ^ lane)
        left = left[rest > 8]
        if not len(left):
            return out
    for i in left.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words:
    """The words (runs without white space: bytes 32 and 9 to 13) of some UTF-8 texts, in order.

    hashes: of each word; first: where each text's words begin, and the end; start, end: bytes in ``joined``.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b" ".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        if lower:
            raw = _LOWER[raw]
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
        change = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = change[::2], change[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_at = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.start, self.text_at)
        self.hashes = _hashed(raw, self.start, self.end)

    def room(self) -> np.ndarray:
        """For each word: how many words its text has from there on."""
        ends = np.repeat(self.first[1:], np.diff(self.first))
        return ends - np.arange(len(self.hashes))


def spans(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences from ``start`` to ``end``, wherever they stand: two runs of a power of two words that
    cover the sequence, and its length. Empty sequences have 0."""
    size = end - start
    out, level = np.zeros(len(start), np.uint64), np.frexp(size.astype(np.float64))[1] - 1
    most, step, runs = int(level.max(initial=-1)), 1, hashes
    for k in range(most + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = mix(combine(runs[start[at]], runs[end[at] - step]) + size[at].astype(np.uint64) * _SIZE)
        if k < most:
            runs, step = combine(runs[:-step], runs[step:]), 2 * step
    return out


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all sequences of ``width`` words, by where they begin; as :func:`spans` gives them."""
    at = np.arange(max(0, len(hashes) - width + 1))
    return spans(hashes, at, at + width)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows of a batch with their texts' bytes (null: empty), about ``most_bytes`` each; one text at least.

    Only one run's texts are Python objects at a time.
    """
    texts = batch.column(column)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) + 1) if batch.num_rows else np.zeros(0, np.int64)
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + most_bytes)))
        yield at, [t or b"" for t in texts.slice(at, to - at).cast(pa.binary()).to_pylist()]
        at = to


def once(batches: Iterable[pa.RecordBatch], *columns: int) -> Iterator[pa.RecordBatch]:
    """The rows whose key, which these columns make, no earlier row of the task has."""
    seen: set[tuple] = set()
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in columns))
        new = [k not in seen and not seen.add(k) for k in keys]
        yield batch if all(new) else batch.filter(pa.array(new, pa.bool_()))


def of(batches: Iterable[pa.RecordBatch], column: int, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Each slice of the batches with its words."""
    let_go()
    for batch in batches:
        for at, texts in slices(batch, column):
            yield batch.slice(at, len(texts)), Words(texts, lower)
