"""Alignment of two tokenizers over a corpus, on Arrow arrays.

A text is tokenised by a byte-level vocabulary (A, on a space and the text) and by a sentence-piece
model (B, which puts the space before it itself).  The ids of a batch are one flattened list with the parent
index of each; the byte where a token ends in its document is a cumulative sum of token lengths,
segmented by document.  An Acero hash join on (document, end) gives the links: pairs of
tokens that end together.  Where links are, both sequences are cut into groups.

How often a pair of ids is linked in the whole corpus is counted in parts by ``Table.group_by``
in the tasks, and the parts are added by Spark.  Documents are dealt to chunks of about ``CHUNK``
bytes; the different pairs of a chunk, not its links, are joined with the counts, so a frequent pair
has one row for each chunk, and the counts come back to the chunk's documents, where another hash join
puts them to the links.  Nothing is broadcast or collected.

Undefined cases: a text that is null or empty, or whose joined tokens of either side are not the
bytes of the space and the text (as where a model normalises), has no tokens, counts of 0, and an empty
hash; strings of special tokens are plain text; repeated rows are counted each; texts of any
length are whole.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm import packing, pretokens
from factorloom.llm.frames import slices
from factorloom.session import materialize

SLICE = 1 << 19           # bytes of text tokenised at a time
CHUNK = 4 << 20           # bytes of text whose different pairs are counted together
LINKS = 1 << 18           # links unpacked at a time


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable Latin-1 characters
    are themselves, the other bytes follow in order from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """Ids of texts, and the bytes of each id."""

    def __init__(self, ids, codes: list[bytes]):
        self.ids = ids                                    # texts -> flat ids, first of each text
        self.codes = pa.array(codes, pa.large_binary())
        self.decimal = pc.cast(pa.array(np.arange(len(codes))), pa.large_string())

    def lists(self, texts: pa.Array) -> pa.LargeListArray:
        flat, first = self.ids(texts)
        return pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), pa.array(flat, pa.int32()))


@lru_cache(2)
def byte_side(path: str) -> Side:
    encoder = packing.encoder(path)
    from tokenizers import Tokenizer

    symbol = byte_of_symbol()
    vocabulary = Tokenizer.from_file(path).get_vocab()
    codes = [b""] * (max(vocabulary.values()) + 1)
    for token, at in vocabulary.items():
        codes[at] = bytes(symbol[c] for c in token) if all(c in symbol for c in token) else token.encode()
    return Side(lambda texts: encoder.ids(_after_space(texts)), codes)


@lru_cache(2)
def piece_side(path: str) -> Side:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    codes = [bytes([int(model.id_to_piece(k)[1:-1], 16)]) if model.is_byte(k)
             else model.id_to_piece(k).replace("▁", " ").encode() for k in range(model.get_piece_size())]

    def whole(texts: pa.Array):
        found = model.encode(texts.to_pylist(), num_threads=1)
        first = np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))
        return np.fromiter(chain.from_iterable(found), np.int32, int(first[-1])), first

    space = np.array([model.piece_to_id("▁")], "<u4").tobytes()

    def encode(pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that begin with a space, which the model puts there itself."""
        found = model.encode([x[1:].decode() for x in pieces], num_threads=1)
        return [array("I", ids).tobytes() if ids else space for ids in found]

    words = pretokens.Remembered(encode, split=pretokens.spaced)
    return Side((lambda texts: words.ids(_after_space(texts))) if _by_words(model) else whole, codes)


#: A text in which a model that changes texts changes something.
_PROBE = " a  b ﬁ ½ Å Å ｱ\u3000…  "


def _by_words(model) -> bool:
    """Whether a text's ids are those of its runs of spaces with what follows each: no piece goes on
    over the beginning of a run, and the model leaves texts as they are.  (A text that itself has the
    model's mark for a space has no tokens in the end, as its bytes are not the tokens'.)"""
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in pieces):
        return False
    found = b"".join(bytes([int(p[1:-1], 16)]) if model.is_byte(k) else p.encode()
                     for k in model.encode(_PROBE) for p in [pieces[k]])
    return found.decode() == "▁" + _PROBE.replace(" ", "▁")


def _after_space(texts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(_text(" "), texts, _text(""))


def placed(side: Side, lists: pa.LargeListArray, expected: pa.Array) -> tuple[pa.Table, np.ndarray]:
    """``doc``, ``end`` (the byte after the token in its document) and ``id`` of every token, and which
    documents' tokens are the expected bytes."""
    flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    codes = side.codes.take(flat)
    total = pc.cumulative_sum(pc.binary_length(codes).cast(pa.int64()))
    first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    sums = np.concatenate(([0], total.to_numpy()))
    end = pc.subtract(total, pa.array(sums[first[:-1]]).take(doc)) if len(flat) else total
    whole = b"" if not len(flat) else codes.buffers()[2].to_pybytes()
    cuts, own = sums[first].tolist(), expected.to_pylist()
    good = np.array([whole[p:q] == text for p, q, text in zip(cuts, cuts[1:], own)], bool)
    return pa.table({"doc": doc.cast(pa.int64()), "end": end, "id": flat}), good


def links(a: pa.Table, b: pa.Table) -> pa.Table:
    """``doc``, ``end``, ``a`` and ``b`` of all pairs of tokens that end together, in order."""
    found = a.rename_columns(["doc", "end", "a"]).join(
        b.rename_columns(["doc", "end", "b"]), keys=["doc", "end"], join_type="inner", use_threads=False)
    return found.sort_by([("doc", "ascending"), ("end", "ascending")])


def _keys(table: pa.Table) -> np.ndarray:
    return (table["doc"].to_numpy() << 40) | table["end"].to_numpy()


def grouped(a: pa.Table, b: pa.Table, common: np.ndarray, docs: int, sides: tuple[Side, Side]) -> list[str]:
    """``a1,a2|b1;…`` of each document, cut at the common ends."""
    parts = []
    for side, table in zip(sides, (a, b)):
        group = np.searchsorted(common, _keys(table))
        offsets = pa.array(np.searchsorted(group, np.arange(len(common) + 1)), pa.int64())
        ids = table["id"].combine_chunks()
        parts.append(pc.binary_join(pa.LargeListArray.from_arrays(offsets, side.decimal.take(ids)), _text(",")))
    both = pc.binary_join_element_wise(*parts, _text("|"))
    first = np.searchsorted(common >> 40, np.arange(docs + 1))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), both), _text(";")).to_pylist()


_ALIGNED = ("key_ long, chunk long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "links binary")
_NAMES = [x.split()[0] for x in _ALIGNED.split(", ")]


def aligned_batch(texts: pa.Array, sides: tuple[Side, Side]) -> list[pa.Array]:
    """For each text the numbers of tokens, groups and links, the groups' hash, and the linked ids."""
    n = len(texts)
    filled = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
    own = texts.take(pa.array(filled)).cast(pa.large_string())
    expected = _after_space(own).cast(pa.large_binary())
    (a, good_a), (b, good_b) = (placed(side, side.lists(own), expected) for side in sides)
    good = good_a & good_b
    a, b = (t.filter(pa.array(good[t["doc"].to_numpy()])) for t in (a, b))
    found = links(a, b)
    docs = len(filled)
    common = _keys(found)  # ascending
    common = common[np.append(True, common[1:] != common[:-1])] if len(common) else common
    texts_of_groups = grouped(a, b, common, docs, sides)

    def per_text(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[filled] = np.bincount(values, minlength=docs)
        return out

    hashes = np.full(n, "", object)
    hashes[filled] = [hashlib.sha256(x.encode()).hexdigest() if ok else "" for x, ok in zip(texts_of_groups, good)]
    counts = [per_text(x) for x in (a["doc"].to_numpy(), b["doc"].to_numpy(), common >> 40, found["doc"].to_numpy())]
    one, two, ends = found["a"].to_numpy(), found["b"].to_numpy(), np.concatenate(([0], np.cumsum(counts[3])))
    held = [packed_links(one[p:q], two[p:q]) for p, q in zip(ends.tolist(), ends[1:].tolist())]
    return [*map(pa.array, counts), pa.array(hashes, pa.string()), pa.array(held, pa.binary())]


def packed_links(a: np.ndarray, b: np.ndarray) -> bytes:
    """The ids of a document's links, all of A and then all of B, compressed: links are as many as
    tokens, and this is what is written and shuffled of them."""
    if not len(a):
        return b""
    width = 2 if max(a.max(), b.max()) < 1 << 16 else 4
    raw = np.concatenate((a, b)).astype(f"<u{width}").tobytes()
    return width.to_bytes(1, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def links_of(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not packed:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    raw = pa.decompress(packed[9:], int.from_bytes(packed[1:9], "little"), "zstd", asbytes=True)
    ids = np.frombuffer(raw, f"<u{packed[0]}").astype(np.int32)
    return ids[:len(ids) // 2], ids[len(ids) // 2:]


def _aligned(a_path: str, b_path: str):
    def run(batches):
        sides = byte_side(a_path), piece_side(b_path)
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for part in slices(batches, 1, SLICE):
            if held > CHUNK:
                chunk, held = chunk + 1, 0
            held += part.column(1).nbytes
            made = aligned_batch(part.column(1), sides)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.full(part.num_rows, chunk)), *made], _NAMES)
    return run


def _flat(table: pa.Table, *kept: str) -> pa.Table:
    """A row for each link: the kept columns of its document, and the ids."""
    sides = [links_of(x) for x in table["links"].to_pylist()]
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(a) for a, _ in sides], dtype=np.int64))), pa.int64())
    a, b = (pa.LargeListArray.from_arrays(offsets, pa.array(np.concatenate([*[x[k] for x in sides], np.zeros(0, np.int32)])))
            for k in (0, 1))
    of = pc.list_parent_indices(a)
    return pa.table({**{c: table[c].take(of) for c in kept}, "a": pc.list_flatten(a), "b": pc.list_flatten(b)})


def _parts(table: pa.Table):
    """Consecutive rows with at most about ``LINKS`` links."""
    ends, low = np.cumsum(table["n_links"].to_numpy()), 0
    while low < table.num_rows:
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + LINKS, "right")))
        yield table.slice(low, high - low)
        low = high


def _partial_counts(batches):
    """The pairs of a batch and how many links have each, by chunk."""
    for batch in batches:
        for part in _parts(pa.Table.from_batches([batch])):
            found = _flat(part, "chunk")
            if found.num_rows:
                counted = found.group_by(["chunk", "a", "b"], use_threads=False).aggregate([([], "count_all")])
                yield from counted.select(["chunk", "a", "b", "count_all"]).rename_columns(
                    ["chunk", "a", "b", "n"]).combine_chunks().to_batches()


_SUMS = ("key_ long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
         "groups_sha256 string")


def _summed(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """The counts of a chunk's pairs added over the links of each of its documents."""
    rows = rows.append_column("row", pa.array(np.arange(rows.num_rows)))
    pairs = pairs.select(["a", "b", "n", "best"])
    best, sums = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
    for part in _parts(rows):
        joined = _flat(part, "row").join(pairs, keys=["a", "b"], join_type="inner", use_threads=False)
        joined = joined.group_by("row", use_threads=False).aggregate([("best", "sum"), ("n", "sum")])
        at = joined["row"].to_numpy()
        best[at], sums[at] = joined["best_sum"].to_numpy(), joined["n_sum"].to_numpy()
    return pa.table({**{c: rows[c] for c in ("key_", "n_a", "n_b", "n_groups", "n_links")},
                     "n_best": pa.array(best), "count_sum": pa.array(sums), "groups_sha256": rows["groups_sha256"]})


def align(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key_``, ``chunk``, counts, ``groups_sha256`` and the ``links`` (see ``links_of``) of every row, written."""
    rows = df.select(F.col(key).cast("long").alias("key_"), F.col(text).alias("body"))
    return materialize(rows.mapInArrow(_aligned(os.fspath(a_path), os.fspath(b_path)), _ALIGNED), "aligned")


def pair_counts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different pairs of each ``chunk``, and for all pairs of the corpus ``n``, the number of links,
    and ``best``, 1 where no other pair of the same ``b`` has more."""
    parts = materialize(aligned.select("chunk", "n_links", "links").mapInArrow(
        _partial_counts, "chunk long, a int, b int, n long"), "pairs")
    counts = materialize(parts.groupBy("a", "b").agg(F.sum("n").alias("n")), "counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    scored = counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    return parts.select("chunk", "a", "b").distinct(), scored


def statistics(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its tokens, groups and links, how many links are the best of their ``b``,
    and the sum of their counts."""
    aligned = align(df, a_path, b_path, key, text)
    pairs, scored = pair_counts(aligned)
    known = pairs.join(scored, ["a", "b"])
    return (aligned.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_summed, _SUMS)
            .withColumnRenamed("key_", key))
