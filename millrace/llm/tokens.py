"""Token ids of whole texts by the tokenizers library, inside Spark tasks.

Invented and natural corpora repeat their words, and both public vocabularies never merge across a single space between
two characters that are no white space. So texts are cut there, many at a time by Arrow, and pieces into a word and signs after it; each distinct
word goes through the library once, its ids are kept in a bounded cache of the worker, and numpy puts the texts' ids together.
tests/llm/test_tokens.py compares this with whole-text encoding.
"""

from __future__ import annotations

import array
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.llm.shared import CACHES

#: A cut is safe where one plain space stands between characters that no Unicode version counts as white space.
_SAFE = re.compile(r"(?<=[^\s᠎​﻿]) (?=[^\s᠎​﻿])")
#: What some Unicode version counts as white space, but for the plain space and the line feed.
_OTHER_SPACE = [c for c in map(chr, [*range(9), *range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]) if c != "\n"]


_SPACES = "".join(rf"\x{{{ord(c):x}}}" for c in [*_OTHER_SPACE, " ", "\n"])
#: Texts in which some plain space or line feed does not stand alone between characters that are no white space; and those
#: with the character that marks a text's first piece.
_IRREGULAR = rf"\A[ \n]|[ \n]\z|[ \n][{_SPACES}]|[{_SPACES}][ \n]|\x01"
_FIRST = "\x01"


#: Longer pieces are encoded each time, so that keys stay small.
LONGEST_KEY = 64
#: Letters whose lower case is one letter and that no normal form changes when they stand in a row.
_PLAIN_CHARACTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
#: A piece's mark, its word, and signs after it, which are one word for either pre-tokenizer.
_SIGNS = r"!-/:-@\[-`{-~"
_PLAIN = re.compile(rf"([\n\x01]?)([{_PLAIN_CHARACTERS}]+)([{_SIGNS}]*)").fullmatch
_PLAIN_PARTS = rf"\A(?P<mark>[\n\x01]?)(?P<word>[{_PLAIN_CHARACTERS}]+)(?P<signs>[{_SIGNS}]*)\z"


class _Generations(dict):
    """key -> ids as bytes. When it is full the older half goes; what is used again is kept."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.encode(key)
        if len(key) <= LONGEST_KEY:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


def _bytes(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes()


def _gathered(stock: np.ndarray, size: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Runs of ``stock`` in the order of ``index``; run k has size[k] entries and follows run k - 1."""
    n, starts = size[index], (np.cumsum(size) - size)[index]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(stock)) < 2**31 else np.int64
    at = np.repeat((starts - (ends - n)).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return stock[at]


class Encoder:
    """Ids of texts as the library gives them without added special tokens; such tokens' strings in a text are tokens.

    Lines of regular texts are cut apart too: a lone line feed is a piece of its own. A piece of Latin letters and then
    signs is two words for either pre-tokenizer; such pieces go to the library's model directly, all others
    through its whole chain. Texts with the string of a special token go through it whole.
    """

    def __init__(self, path: str, cache_entries: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.lower = t.normalizer is not None and t.normalizer.normalize_str("A") == "a"
        self.spaced = t.pre_tokenizer.pre_tokenize_str(" a")[0][0] != "a"
        stand_in = {chr(c): t.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in map(ord, _PLAIN_CHARACTERS)}
        self.table = str.maketrans(stand_in)
        self.space = t.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1] if self.spaced else ""
        self.model = t.model
        self.feed = _bytes(self.whole("\n"))
        self.words, self.signs = _Generations(self.word, cache_entries), _Generations(self.word, 10_000)
        self.pieces = _Generations(self.piece, 50_000)
        special = [re.escape(a.content) for a in t.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or r"(?!)").search
        self.irregular = "|".join([_IRREGULAR, *special])

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word(self, word: str) -> bytes:
        """The ids of a word of Latin letters, after a space or not, or of signs: each is one word for the pre-tokenizer."""
        if self.lower:
            word = word.lower()
        if not word.isascii():
            word = word.translate(self.table)
        if word[0] == " ":
            word = self.space + word[1:]
        return _bytes([x.id for x in self.model.tokenize(word)])

    def piece(self, key: str) -> bytes:
        """The ids of a piece: after a line feed (then with the feed's), first in its text (marked), or after a space."""
        m = _PLAIN(key)
        if m is None:
            if key[:1] == "\n":
                return self.feed + _bytes(self.whole(key[1:]))
            return _bytes(self.whole(key[1:] if key[:1] == _FIRST else " " + key))
        mark, word, signs = m.groups()
        ids = self.words[word if mark or not self.spaced else " " + word]
        if mark == "\n":
            ids = self.feed + ids
        return ids + self.signs[signs] if signs else ids

    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after the other, and how many each has."""
        parts = pc.extract_regex(pieces, _PLAIN_PARTS)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        mark, word, signs = parts.filter(pa.array(plain)).flatten()
        feeds = pc.equal(mark, "\n").to_numpy(zero_copy_only=False)
        if self.spaced:
            word = pc.if_else(pc.equal(mark, ""), pc.binary_join_element_wise(" ", word, ""), word)
        word, signs = word.dictionary_encode(), signs.dictionary_encode()
        listed = lambda a: a.to_numpy(zero_copy_only=False).tolist()
        odd = [self.pieces[p] for p in listed(pieces.filter(pa.array(~plain)))]
        words = [self.words[w] for w in listed(word.dictionary)]
        marks = [self.signs[s] if s else b"" for s in listed(signs.dictionary)]
        stock = [b"", self.feed, *odd, *words, *marks]
        runs = np.zeros((len(pieces), 3), np.int64)  # of a piece: its feed, its word or all of it, its signs
        runs[plain, 0] = feeds
        runs[~plain, 1] = np.arange(len(odd)) + 2
        runs[plain, 1] = word.indices.to_numpy() + (2 + len(odd))
        runs[plain, 2] = signs.indices.to_numpy() + (2 + len(odd) + len(words))
        size = np.fromiter(map(len, stock), np.int64, len(stock)) // 4
        return _gathered(np.frombuffer(b"".join(stock), "<u4"), size, runs.ravel()), size[runs].sum(axis=1)

    def one(self, text: str) -> np.ndarray:
        """The ids of any text, cut where that is safe."""
        if self.special(text):
            return np.array(self.whole(text), "<u4")
        first, *rest = _SAFE.split(text)
        ids = [_bytes(self.whole(first))]
        for p in rest:
            ids.append(self.pieces[p] if p[0] != _FIRST else _bytes(self.whole(" " + p)))
        return np.frombuffer(b"".join(ids), "<u4")

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.irregular)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.one(texts[i].as_py())
        regular = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        if len(regular):
            marked = pc.binary_join_element_wise(_FIRST, pc.replace_substring(texts.take(pa.array(regular)), "\n", " \n"), "")
            cut = pc.split_pattern(marked, " ")
            keys = cut.flatten().dictionary_encode()
            stock, size = self.distinct(keys.dictionary)
            index, stops, at = keys.indices.to_numpy(), cut.offsets.to_numpy()[1:], 0
            ends = np.cumsum(size[index])[stops - 1]
            flat = _gathered(stock, size, index)
            for i, to in zip(regular.tolist(), ends.tolist()):
                out[i] = flat[at:to]
                at = to
        return out

    def encode(self, text: str) -> bytes:
        return self.many(pa.array([text], pa.string()))[0].tobytes()


_ENCODERS: dict[str, Encoder] = {}
CACHES.append(_ENCODERS)


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker; its cache outlives tasks, until the worker goes on to others."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches: Iterable[pa.RecordBatch], path: str, *, most_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches, of about ``most_bytes`` of text or one row, with the ids of their last column's texts."""
    enc = encoder(path)
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + most_bytes)))
            yield batch.slice(at, to - at), enc.many(column.slice(at, to - at))
            at = to
