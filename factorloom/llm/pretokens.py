"""The split of texts that byte-level BPE vocabularies are made for, on whole Arrow batches.

Gives the same pieces as matching ``public_tokenizers.PATTERN`` from left to right:
contractions, runs of letters, numbers or other marks with one space before them, and
white space, whose last character is left to what follows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from factorloom.llm import hashing

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: What follows an apostrophe in a contraction.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000))).astype("<u4")
    every, table = points.tobytes().decode("utf-32-le"), np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            table[points[found.start():found.end()]] = kind
    return table


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where each piece starts and how long it is (bytes), and the
    first piece of each text (one entry more than texts)."""
    data, offsets = hashing.text_bytes(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(offsets), np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)  # the byte where each character starts
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = _classes()[chars]
    n = len(chars)
    first = np.searchsorted(at, offsets)  # the first character of each text
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    change = opens.copy()
    change[1:-1] |= kind[1:] != kind[:-1]
    change[-1] = True
    start = np.flatnonzero(change[:-1])
    end = np.append(start[1:], n)
    run = kind[start]
    begins = np.zeros(n + 1, bool)
    solid = run != SPACE
    before = np.maximum(start - 1, 0)
    joins = solid & ~opens[start] & (chars[before] == 0x20)
    begins[start[solid] - joins[solid]] = True
    blank = ~solid
    last, final = end - 1, opens[end] | (end == n)
    plain = chars[last] == 0x20
    begins[start[blank & (final | ~plain | (end - start > 1))]] = True
    begins[last[blank & ~final & ~plain]] = True
    # contractions: an apostrophe alone, no space joined to it, before letters of the same text
    mark = np.flatnonzero((run[:-1] == OTHER) & (run[1:] == LETTER) & (end[:-1] - start[:-1] == 1)
                          & (chars[start[:-1]] == 0x27) & ~joins[:-1] & ~opens[end[:-1]]) if len(run) > 1 else start[:0]
    if len(mark):
        low = end[mark]
        one = chars[low]
        two = np.where(low + 1 < end[mark + 1], chars[np.minimum(low + 1, n - 1)], 0)
        size = np.zeros(len(mark), np.int64)
        for suffix in SUFFIXES:
            fits = one == ord(suffix[0])
            fits &= (two == ord(suffix[1])) if len(suffix) == 2 else True
            size = np.where(fits & (size == 0), len(suffix), size)
        held = size > 0
        begins[low[held]] = False
        rest = low[held] + size[held]
        begins[rest[rest < end[mark[held] + 1]]] = True
    begin = np.flatnonzero(begins[:-1])
    from_byte = at[begin]
    return data, from_byte, np.diff(np.append(from_byte, len(data))), np.searchsorted(begin, first)


def spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like ``pieces`` for texts that each begin with a space: a piece is a run of spaces and what follows it."""
    data, offsets = hashing.text_bytes(texts)
    begins = data == 0x20
    begins[1:] &= data[:-1] != 0x20
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(begins)
    return data, start, np.diff(np.append(start, len(data))), np.searchsorted(start, offsets)


def distinct(texts: pa.Array, split=pieces) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces (binary), told apart by their bytes, which one each piece is, and
    the first piece of each text."""
    data, start, _, first = split(texts)
    ends = np.append(start, len(data)).astype(np.int64)  # pieces follow each other without gaps
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [
        None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), first


class Remembered:
    """The ids of pieces, held by the bytes of the piece up to about ``limit`` bytes in all.

    Half of it is for new pieces; when that is full the other half is given up, but pieces
    that come up again move over, so frequent ones stay.
    """

    def __init__(self, encode, limit: int = 48 << 20, split=pieces):
        self.encode, self.limit, self.split = encode, limit, split
        self.held, self.known, self.older = 0, {}, {}

    def _learn(self, keys: list[bytes]) -> None:
        if self.held > self.limit // 2:
            self.held, self.known, self.older = 0, {}, self.known
        known, older = self.known, self.older
        missing = [k for k in keys if k not in known]
        again = [(k, older[k]) for k in missing if k in older]
        new = [k for k in missing if k not in older]
        made = list(zip(new, self.encode(new)))
        for pairs in (again, made):
            known.update(pairs)
            self.held += sum(160 + len(k) + len(ids) for k, ids in pairs)  # two objects and their entry

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and where those of each begin (one entry more than texts)."""
        values, which, first = distinct(texts, self.split)
        keys = values.to_pylist()
        self._learn(keys)
        parts = [self.known[k] for k in keys]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, low = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
        counts = size[which]
        ends = np.concatenate(([0], np.cumsum(counts)))
        take = np.arange(int(ends[-1])) + np.repeat(low[which] - ends[:-1], counts)
        return flat[take], ends[first]
