"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

A vocabulary of ranks becomes a table of merges (left token, right token, merged token).
The distinct pieces of a batch of texts become rows of (piece, position, token); each step
of a recursive query joins neighbouring tokens with the merges, finds the leftmost pair of
minimum rank of every piece and contracts it, until no piece has a pair left.  A piece that
is a token by itself is taken as such.  Decoding joins the tokens of each text with their
bytes and puts these together in an aggregation ordered by position.

The database is in memory, of one thread and ``MEMORY``, and belongs to the Python worker of a
task.  Batches are bounded in bytes, and a query runs at most ``STEPS`` steps, fewer if it has
many rows, before its last rows begin the next one, so memory is bounded for long pieces too;
a piece of n bytes takes up to n steps.

Undefined cases: a null text counts as empty, and an empty one has no ids and decodes to
no bytes; special tokens are ordinary text; null ids decode to nothing; an id that is not in the
vocabulary fails the task.  Repeated rows are encoded alike.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factorloom.llm import pretokens
from factorloom.llm.frames import beside, named, slices

STEPS = 32
ROWS = 100_000            # token rows of a recursive query
HELD = 2_000_000          # token rows of all its steps together
TOKENS = 100_000          # token rows of a decoding query
TEXT_BYTES = 1 << 20      # of texts cut into pieces at a time
CACHED = 48 << 20         # bytes of pieces with their ids that a task remembers
MEMORY = "128MB"          # of the database

# A place is the piece in the upper and the position in the lower 32 bits.
_ENCODE = """
WITH RECURSIVE state(step, place, id) AS (
  SELECT 0, place, id FROM begin_rows
  UNION ALL
  (WITH paired AS (
     SELECT step, place, id, place >> 32 AS piece, lead(id) OVER w AS next_id,
            lead(place) OVER w AS next_place, lag(place) OVER w AS last_place
     FROM state WHERE step < $steps WINDOW w AS (ORDER BY place)),
   best AS (
     SELECT p.piece, min((m.merged::BIGINT << 32) | (p.place & 4294967295)) AS pair
     FROM paired p JOIN merges m ON p.id = m.left_id AND p.next_id = m.right_id
     WHERE p.piece = p.next_place >> 32 GROUP BY p.piece)
   SELECT p.step + 1, p.place,
          CASE WHEN p.place & 4294967295 = b.pair & 4294967295 THEN (b.pair >> 32)::INTEGER ELSE p.id END
   FROM paired p JOIN best b ON p.piece = b.piece
   WHERE p.last_place IS DISTINCT FROM ((b.piece << 32) | (b.pair & 4294967295)))),
ends AS (SELECT place >> 32 AS piece, max(step) AS step FROM state GROUP BY 1)
SELECT s.place, s.id, s.step FROM state s JOIN ends e ON s.place >> 32 = e.piece AND s.step = e.step
ORDER BY s.place
"""

_DECODE = """
SELECT r.doc, string_agg(t.code, '' ORDER BY r.pos) AS code, count(*) AS n
FROM id_rows r JOIN tokens t ON r.id = t.id GROUP BY r.doc ORDER BY r.doc
"""


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(2)
def _database(path: str):
    """A connection with ``tokens`` and ``merges``, the vocabulary, and the ids of bytes."""
    import duckdb

    known = ranks(path)
    merges = np.fromiter((x for t, rank in known.items() for k in range(1, len(t))
                          if t[:k] in known and t[k:] in known for x in (known[t[:k]], known[t[k:]], rank)),
                         np.int32).reshape(-1, 3)
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    con.register("merge_rows", pa.table({name: pa.array(merges[:, k].copy()) for k, name in
                                         enumerate(("left_id", "right_id", "merged"))}))
    con.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
    con.register("token_rows", pa.table({"id": pa.array(list(known.values()), pa.int32()),
                                         "code": [t.hex() for t in known]}))
    con.execute("CREATE TABLE tokens AS SELECT * FROM token_rows")
    singles = np.array([known.get(bytes([b]), -1) for b in range(256)], np.int32)
    return con, known, singles


def _contract(con, place: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece and id of the rows that are left, by piece and position."""
    pieces, ids = [], []
    while len(place):
        con.register("begin_rows", pa.table({"place": place, "id": token}))
        steps = min(STEPS, max(1, HELD // len(place)))  # the query keeps the rows of every step
        found = con.sql(_ENCODE, params={"steps": steps}).to_arrow_table()
        place, token, step = (found[c].to_numpy() for c in ("place", "id", "step"))
        going = step >= steps  # perhaps not at the end yet
        pieces.append(place[~going] >> 32)
        ids.append(token[~going])
        place, token = place[going], token[going]
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    pieces, ids = np.concatenate(pieces), np.concatenate(ids)
    order = np.argsort(pieces, kind="stable")
    return pieces[order], ids[order]


def encode_pieces(path: str, pieces: list[bytes]) -> list[bytes]:
    """The ids (32 bits, little-endian) of each piece."""
    con, known, singles = _database(path)
    out: list[bytes] = [b""] * len(pieces)
    rest = []
    for k, piece in enumerate(pieces):
        whole = known.get(piece)
        if whole is None:
            rest.append(k)
        else:
            out[k] = whole.to_bytes(4, "little")
    rest.sort(key=lambda k: len(pieces[k]))  # long pieces take many steps and go together
    low = 0
    while low < len(rest):
        high, rows = low, 0
        while high < len(rest) and (high == low or rows + len(pieces[rest[high]]) <= ROWS):
            rows += len(pieces[rest[high]])
            high += 1
        size = np.array([len(pieces[k]) for k in rest[low:high]])
        data = np.frombuffer(b"".join(pieces[k] for k in rest[low:high]), np.uint8)
        pos = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
        piece, ids = _contract(con, (np.repeat(np.arange(high - low), size) << 32) | pos, singles[data])
        cuts = np.searchsorted(piece, np.arange(high - low + 1))
        for k, (p, q) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            out[rest[low + k]] = ids[p:q].astype("<i4").tobytes()
        low = high
    return out


def decode_lists(path: str, lists: list[np.ndarray]) -> list[bytes]:
    """The bytes of each list of ids."""
    con, _, _ = _database(path)
    size = np.array([len(x) for x in lists], np.int64)
    ids = np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32)
    doc = np.repeat(np.arange(len(lists), dtype=np.int32), size)
    pos = (np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    con.register("id_rows", pa.table({"doc": doc, "pos": pos, "id": ids}))
    out, known = [b""] * len(lists), 0
    for row, code, n in con.execute(_DECODE).fetchall():
        out[row] = bytes.fromhex(code)
        known += n
    if known != len(ids):
        raise ValueError("an id is not in the vocabulary")
    return out


def _encoded(path: str):
    def run(batches):
        known = pretokens.Remembered(lambda pieces: encode_pieces(path, pieces), CACHED)
        for part in slices(batches, 0, TEXT_BYTES):
            ids, first = known.ids(part.column(0))
            yield named(part, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)),
                                                       pa.array(ids.astype(np.int32))))
    return run


def _decoded(path: str):
    def run(batches):
        for batch in batches:
            column = batch.column(0)
            lists = [np.zeros(0, np.int32) if x is None else x for x in (
                column[k].values.to_numpy() if column[k].is_valid else None for k in range(len(column)))]
            ends = np.cumsum([len(x) for x in lists])
            low = 0
            while low < len(lists):
                base = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, base + TOKENS, "right")))
                found = pa.array(decode_lists(path, lists[low:high]), pa.binary())
                yield named(batch.slice(low, high - low), found)
                low = high
    return run


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` without its text, with the ids of each."""
    return beside(df, text, _encoded(os.fspath(vocabulary)), {ids: "array<int>"})


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its ids stand for."""
    return beside(df, ids, _decoded(os.fspath(vocabulary)), {decoded: "binary"}, keep=True)
