"""Cost-balanced packing of documents into training sequences.

A document is its token ids and an end mark.  Whole blocks of ``CAPACITY`` ids are
sequences by themselves; what is left over of the documents is packed: pieces in descending
length go to the sequence with the lowest estimated cost (linear plus quadratic in the length
of each piece, as attention stays within a document) that has room for them.  A piece
that fits nowhere is cut to what the lowest-cost sequence with room still takes.

There are exactly as many sequences as the ids of a batch fill; the rest waits for the next
batch, and the last rest of a task goes to sequences of power-of-two lengths, which
need no padding.  Each task packs its own documents in batches of ``BATCH`` ids, so nothing is
shuffled and memory does not grow with the data.

Undefined cases: a null text counts as empty, and an empty one is its end mark alone; texts
of any length are tokenised whole, and repeated rows are packed each.  An empty table gives
no rows.  Sequence numbers are unique and depend on the input's partitions; read it from a
table, so that a repeated task sees the same rows.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm import pretokens
from factorloom.llm.frames import slices

CAPACITY = 1024
END = 0
LINEAR, QUADRATIC = 1.0, 1 / 1024
BATCH = 1 << 20
ROW = 2048                # new words encoded in one string
REMEMBERED = 96 << 20     # bytes of pieces with their ids that a worker keeps


def cost(length, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * length + quadratic * length * length


class Encoder(pretokens.Remembered):
    """Ids of whole texts; each distinct piece of a text is encoded once and remembered."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True

        vocabulary_ = tokenizer.get_vocab()
        sizes = np.zeros(max(vocabulary_.values()) + 1, np.int64)  # bytes of each token
        for token, at in vocabulary_.items():
            sizes[at] = len(token)

        def ids(strings: list[str]) -> list[bytes]:
            return [array("I", found.ids).tobytes()
                    for found in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

        def encode(pieces: list[bytes]) -> list[bytes]:
            """Pieces of a space and a word are encoded in rows, which the library cuts at the spaces
            again, and their ids are told apart by the bytes of the tokens."""
            strings = [x.decode() for x in pieces]
            in_row = [len(x) > 1 and x[0] == " " and not x[1].isspace() for x in strings]
            alone = ids([x for x, row in zip(strings, in_row) if not row])
            words = [x for x, row in zip(strings, in_row) if row]
            cut = ids(["".join(words[k:k + ROW]) for k in range(0, len(words), ROW)])
            flat = b"".join(cut)
            ends = np.cumsum(sizes[np.frombuffer(flat, "<u4")])
            held = np.cumsum([len(x) for x, row in zip(pieces, in_row) if row])
            at = np.concatenate(([0], np.searchsorted(ends, held) + 1)) * 4 if len(held) else np.zeros(1, np.int64)
            assert not len(held) or (ends[at[1:] // 4 - 1] == held).all()
            at = at.tolist()
            rows, rest = iter([flat[p:q] for p, q in zip(at, at[1:])]), iter(alone)
            return [next(rows if row else rest) for row in in_row]
        super().__init__(encode, REMEMBERED)


@lru_cache(1)
def encoder(vocabulary: str) -> Encoder:
    """The encoder of a Python worker, for all its tasks."""
    return Encoder(vocabulary)


def assign(lengths: np.ndarray, capacities: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(piece, start in it, length, sequence) for pieces whose lengths sum up to the capacities."""
    room, load, out = capacities.astype(np.int64), np.zeros(len(capacities)), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[piece])
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            at = int(np.argmin(np.where(fits, load, np.inf)))
            part = min(left, int(room[at]))
            out.append((piece, start, part, at))
            room[at] -= part
            load[at] += cost(part)
            start, left = start + part, left - part
    return out


def powers(total: int) -> list[int]:
    return [1 << k for k in reversed(range(total.bit_length())) if total >> k & 1]


_LAYOUT = "key_ long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_NAMES = ["key_", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def _packed(vocabulary: str, end: int):
    def run(batches):
        encode, task = encoder(vocabulary), TaskContext.get().partitionId()
        counter, waiting, held = task << 40, [], 0  # waiting: (key, start, ids, document's ids)

        def flush(last: bool):
            nonlocal counter, waiting, held
            waiting.sort(key=lambda w: -len(w[2]))
            total = held if last else held // CAPACITY * CAPACITY
            now, room = [], total
            for k, (key, start, ids, whole) in enumerate(waiting):
                if len(ids) > room:
                    break
                now.append((key, start, ids, whole))
                room -= len(ids)
            rest = waiting[len(now):]
            if room:  # the piece that crosses the last border is cut there
                key, start, ids, whole = rest[0]
                now.append((key, start, ids[:room], whole))
                rest[0] = (key, start + room, ids[room:], whole)
            sizes = np.array([CAPACITY] * (total // CAPACITY) + powers(total % CAPACITY), np.int64)
            rows, filled = [], np.zeros(len(sizes), np.int64)
            for piece, low, size, at in assign(np.array([len(w[2]) for w in now], np.int64), sizes):
                key, start, ids, whole = now[piece]
                rows.append((key, start + low, size, whole, counter + at, int(filled[at]), ids[low:low + size].tobytes()))
                filled[at] += size
            counter += len(sizes)
            waiting, held = rest, sum(len(w[2]) for w in rest)
            return rows

        for part in slices(batches, 1, 1 << 20):
            rows = []
            every, cuts = encode.ids(part.column(1))
            cuts = cuts.tolist()
            for key, p, q in zip(part.column(0).to_pylist(), cuts, cuts[1:]):
                ids = np.append(every[p:q], np.uint32(end)).astype("<u4")
                full = len(ids) // CAPACITY * CAPACITY
                for start in range(0, full, CAPACITY):
                    rows.append((key, start, CAPACITY, len(ids), counter, 0, ids[start:start + CAPACITY].tobytes()))
                    counter += 1
                if full < len(ids):
                    waiting.append((key, full, ids[full:], len(ids)))
                    held += len(ids) - full
            if held >= BATCH:
                rows += flush(False)
            if rows:
                yield _batch(rows)
        if waiting:
            yield _batch(flush(True))
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    types = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _NAMES)


def pack(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """A row for each piece: ``key``, its ``start`` and ``length`` in the document of
    ``doc_tokens`` ids, its ``offset`` in ``sequence_id``, and its ``ids`` (little-endian, 32 bits)."""
    ready = df.select(F.col(key).cast("long").alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return ready.mapInArrow(_packed(vocabulary, end), _LAYOUT).withColumnRenamed("key_", key)
