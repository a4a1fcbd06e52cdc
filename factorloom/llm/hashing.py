"""Word and shingle hashes of whole texts, computed on Arrow buffers.

A word is a run of ASCII letters, ASCII digits and non-ASCII bytes of the lower-cased
text.  All functions work on one Arrow array of texts and hold a few times its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20          # bytes hashed at a time
SHINGLE_WORDS = 5

_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[0x80:] = True
for _first, _last in ("09", "az", "AZ"):
    _WORD[ord(_first):ord(_last) + 1] = True


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one entry more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def byte_ranges(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The byte ranges as binary values; the ranges ascend and do not overlap."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[starts + lengths] -= 1
    held = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(ends), pa.py_buffer(data[held])])


def _lane(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Up to eight bytes of each range as a number; ``data`` goes on for eight bytes after the last."""
    every = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    kept = np.clip(lengths, 0, 8).astype(np.uint64)
    return every[starts] & np.where(kept < 8, (np.uint64(1) << (kept * np.uint64(8) & np.uint64(63))) - np.uint64(1),
                                    np.uint64(0xFFFFFFFFFFFFFFFF))


def token_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; the ranges ascend and none is empty or overlaps.

    Ranges of up to 16 bytes are two numbers, mixed one after the other; those of one
    length of up to eight bytes cannot meet.  Longer ones are told apart by their bytes, and each
    different one is hashed by BLAKE2b, so no pattern of letters makes two of them meet.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    found = mix(_lane(padded, starts, lengths)) ^ (lengths.astype(np.uint64) * _ODD)
    second = np.where(lengths > 8, starts + 8, starts)
    found = mix(mix(found) + _lane(padded, second, lengths - 8))
    long = np.flatnonzero(lengths > 16)
    if len(long):
        coded = byte_ranges(data, starts[long], lengths[long]).dictionary_encode()
        digests = b"".join([hashlib.blake2b(x, digest_size=8).digest() for x in coded.dictionary.to_pylist()])
        found[long] = np.frombuffer(digests, np.uint64)[coded.indices.to_numpy()]
    return found


def tokens(texts: pa.Array, classes: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Hashes of all runs of bytes of one class (class 0 separates), the first run of each
    text (one entry more than texts), the byte where each run starts, and ``text_bytes``."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.utf8_lower(texts) if lower else texts
    data, offsets = text_bytes(texts)
    hashes, begins = [], []
    low = 0
    while low < len(data):
        high = min(low + WINDOW, len(data))
        while high < len(data) and classes[data[high]] == classes[data[high - 1]]:  # up to the end of a run
            part = np.flatnonzero(classes[data[high:high + WINDOW]] != classes[data[high - 1]])
            high = high + int(part[0]) if len(part) else min(high + WINDOW, len(data))
        part = classes[data[low:high]]
        edge = np.zeros(high - low + 1, bool)
        inner = offsets[np.searchsorted(offsets, low):np.searchsorted(offsets, high)]
        edge[inner - low] = True
        edge[0] = edge[-1] = True
        change = edge.copy()
        change[1:-1] |= part[1:] != part[:-1]
        start = np.flatnonzero((part > 0) & change[:-1])
        end = np.flatnonzero((part > 0) & change[1:]) + 1
        hashes.append(token_hashes(data[low:high], start, end - start))
        begins.append(start + low)
        low = high
    starts = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return found, np.searchsorted(starts, offsets), starts, (data, offsets)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """``tokens`` of the words of the lower-cased texts."""
    return tokens(texts, _WORD.view(np.uint8), lower=True)


def word_digests(first: np.ndarray, starts: np.ndarray, body: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """A digest (128 bits) of each text's words, put together with zero bytes between; the arguments are
    what ``words`` gives."""
    data, offsets = body
    held = _WORD[data]
    gap = np.zeros(len(data), bool)
    gap[1:] = ~held[1:] & held[:-1]
    gap[offsets[:-1][offsets[:-1] < len(data)]] = False
    kept = held | gap
    flat = np.where(held, data, 0)[kept].astype(np.uint8).tobytes()
    ends = np.concatenate(([0], np.cumsum(kept)))[offsets].tolist()
    return [hashlib.blake2b(flat[p:q].rstrip(b"\0"), digest_size=16).digest() for p, q in zip(ends, ends[1:])]


def shingles(hashes: np.ndarray, first: np.ndarray,
             size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the first of each text.

    A text of fewer words has one shingle, of all its words; one without words has none.
    """
    count = np.diff(first)
    runs = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    start = np.concatenate(([0], np.cumsum(runs)))
    total = int(start[-1])
    at = np.arange(total) - np.repeat(start[:-1], runs) + np.repeat(first[:-1], runs)
    end = np.repeat(first[1:], runs)
    found = np.zeros(total, np.uint64)
    for k in range(size):
        here = at + k
        inside = here < end
        part = hashes[np.minimum(here, max(len(hashes) - 1, 0))] if len(hashes) else found
        found = (found + np.where(inside, part, np.uint64(0x51ED270B))) * _ODD
        found ^= found >> np.uint64(29)
    return mix(found), start


def text_shingles(texts: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    hashes, first, _, _ = words(texts)
    return shingles(hashes, first, size)
