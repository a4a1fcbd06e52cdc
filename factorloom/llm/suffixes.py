"""Benchmark decontamination with suffix arrays of the training text.

The words of the benchmark are numbered; a task numbers those of its texts alike (other words
are 0 and match nothing), shard by shard, and sorts the suffixes of a shard that begin with known
words by their first ``WINDOW`` words.  Every suffix of a benchmark item with ``WINDOW`` words left
is searched by halving, all of them at once, which gives the range of its verbatim matches; from each
match it is followed word by word to its full length.  A word inside any match is hit, and a text
with hit words is affected.

An item of fewer than ``WINDOW`` words, but not none, is searched whole.  Long items are cut into
sections that overlap by ``WINDOW`` - 1 words.  The sections are searched in parts of about ``PART``
bytes, one pass over the texts for each, and only one part is sent to the tasks at a time, so
a benchmark of any size fits; nothing of the texts is shuffled.

Words are runs of ASCII digits, ASCII letters in any case, and characters beyond ASCII; only A to Z are
lower-cased.  Undefined cases: a null or empty text, or one without words, has no words and no
hits; an item without words or a null one is never found; an item without id hits words but is not
listed; items that share an id are listed once; repeated rows are alike; a text that ends
within a window does not match across to the next.  An empty table gives no rows, and with an empty
benchmark nothing is hit.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm import hashing
from factorloom.llm.frames import beside, fresh, named, quoted, slices
from factorloom.session import materialize

WINDOW = 10
SHARD = 2 << 20           # bytes of text of a suffix array
SECTION = 4096            # windows of a section of an item
PART = 16 << 20           # bytes of sections searched in one pass
#: What is not a word, as a pattern.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_INSIDE = hashing._WORD.copy()


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (binary), and the first of each text (one entry more than texts)."""
    data, offsets = hashing.text_bytes(texts)
    data = _LOWER[data]
    inside = _INSIDE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(opens)
    lengths = np.flatnonzero(closes) + 1 - starts
    return hashing.byte_ranges(data, starts, lengths), np.searchsorted(starts, offsets)


def numbered(found: pa.Array, first: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of words, with a 0 before each text and one after the last, and where texts begin."""
    known = pc.fill_null(pc.add(pc.index_in(found, value_set=vocabulary), 1), 0).to_numpy() \
        if len(vocabulary) else np.zeros(len(found), np.int32)
    return np.append(np.insert(known, first[:-1], 0), 0).astype(np.int64), first + np.arange(1, len(first) + 1)


class Wanted:
    """The windows of benchmark sections: their words, numbered, and the items that have each."""

    def __init__(self, ids: list, offsets: list[int], texts: list[str], window: int = WINDOW):
        found, first = words(pa.array(texts, pa.large_string()))
        coded = found.dictionary_encode()
        self.vocabulary, self.window = coded.dictionary, window
        self.line, begin = numbered(found, first, self.vocabulary)
        count = np.diff(first)
        runs = np.where(count >= window, count - window + 1, (count > 0).astype(count.dtype))
        section = np.repeat(np.arange(len(count)), runs)
        at = np.arange(len(section)) - np.repeat(np.cumsum(runs) - runs, runs) + begin[section]
        size = np.minimum(count, window)[section]
        self.bits = max(len(self.vocabulary).bit_length(), 1)
        self.each = 63 // self.bits                      # words in a number of 63 bits
        self.masks = self._masks(size)
        self.line = np.concatenate((self.line, np.zeros(window + self.each, np.int64)))
        keys = [k & m for k, m in zip(self.keys(self.line, at), self.masks)]
        order = np.lexsort((*reversed(keys), size)) if len(at) else at
        new = np.ones(len(order), bool)
        if len(order) > 1:
            new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (*keys, size)], axis=0)
        take = order[new]
        self.at, self.size = at[take], size[take]        # one place of each different window
        self.wanted = [k[take] for k in keys]
        self.masks = [m[take] for m in self.masks]
        which, owner = np.cumsum(new) - 1, section[order]
        self.names = sorted({str(x) for x in ids if x is not None})
        number = {x: k for k, x in enumerate(self.names)}
        item = np.array([-1 if x is None else number[str(x)] for x in ids], np.int64)[owner] if len(ids) else owner
        pairs = np.unique((which[item >= 0] << 32) | item[item >= 0])
        self.items, self.first_item = pairs & 0xFFFFFFFF, np.searchsorted(pairs >> 32, np.arange(len(take) + 1))
        self.section_of = section[take]
        self.word_of = self.at - begin[self.section_of] + np.array(offsets, np.int64)[self.section_of]
        self.ids = [None if x is None else str(x) for x in ids]
        self.least = int(self.size.min()) if len(self.size) else 0

    def _masks(self, size: np.ndarray) -> list[np.ndarray]:
        out = []
        for low in range(0, self.window, self.each):
            held = np.clip(size - low, 0, self.each)
            out.append(((1 << (held * self.bits)) - 1) << ((self.each - held) * self.bits))
        return out

    def keys(self, line: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The first words from each place, put together to numbers that order like them."""
        out = []
        for low in range(0, self.window, self.each):
            key = np.zeros(len(at), np.int64)
            for k in range(low, low + self.each):
                key = (key << self.bits) | (line[at + k] if k < self.window else 0)
            out.append(key)
        return out


class Shard:
    """The sorted suffixes of numbered words that begin with known words."""

    def __init__(self, line: np.ndarray, wanted: Wanted):
        n = len(line)
        gaps = np.flatnonzero(line == 0)
        run = np.append(gaps, n)[np.searchsorted(gaps, np.arange(n))] - np.arange(n)
        at = np.flatnonzero(run >= max(wanted.least, 1)) if wanted.least else gaps[:0]
        padded = np.concatenate((line, np.zeros(wanted.window + wanted.each, np.int64)))
        keys = wanted.keys(padded, at)
        order = np.lexsort(tuple(reversed(keys))) if len(at) else at
        self.line, self.places = padded, at[order]
        self.sorted = [k[order] for k in keys]

    def _bound(self, wanted: Wanted, right: bool) -> np.ndarray:
        low = np.zeros(len(wanted.at), np.int64)
        high = np.full(len(low), len(self.places))
        while (going := low < high).any():
            middle = np.minimum((low + high) >> 1, len(self.places) - 1)
            less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
            for key, want, mask in zip(self.sorted, wanted.wanted, wanted.masks):
                here = key[middle] & mask
                less |= equal & (here < want)
                equal &= here == want
            below = less | equal if right else less
            low, high = np.where(going & below, middle + 1, low), np.where(going & ~below, middle, high)
        return low

    def matches(self, wanted: Wanted) -> tuple[np.ndarray, np.ndarray]:
        """The place of every match, and the window found there."""
        if not len(self.places) or not len(wanted.at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = self._bound(wanted, False)
        count = self._bound(wanted, True) - low
        window = np.repeat(np.arange(len(low)), count)
        within = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
        return self.places[within + low[window]], window

    def longest(self, wanted: Wanted, places: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which matches do not continue one that begins a word earlier, and their length in words."""
        there = wanted.at[windows]
        before = self.line[places - 1]
        opens = np.flatnonzero((before == 0) | (before != wanted.line[there - 1]))
        here, there, size = places[opens], there[opens], wanted.size[windows[opens]].copy()
        going = np.arange(len(opens))
        while len(going):
            one = self.line[here[going] + size[going]]
            going = going[(one != 0) & (one == wanted.line[there[going] + size[going]])]
            size[going] += 1
        return opens, size


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_MATCH = pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("words", pa.int64())])
_ADDED = {"n_words": "long", "hit": "array<struct<start: bigint, end: bigint>>", "items": "array<string>",
          "matches": "array<struct<item: string, item_word: bigint, word: bigint, words: bigint>>"}


def _lists(first: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)


def _searched(sent):
    """For each text the number of words, the spans of hit words, the items, and the longest matches."""
    def run(batches):
        wanted = sent.value
        names = pa.array(wanted.names, pa.string())
        for part in slices(batches, 0, SHARD):
            found, first = words(part.column(0))
            line, begin = numbered(found, first, wanted.vocabulary)
            shard = Shard(line, wanted)
            places, windows = shard.matches(wanted)
            marks = np.bincount(places, minlength=len(line) + 1).astype(np.int64)
            marks -= np.bincount(places + wanted.size[windows], minlength=len(line) + 1)
            inside = np.concatenate(([False], np.cumsum(marks)[:len(line)] > 0, [False]))
            low, high = (np.flatnonzero(x) for x in (inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]))
            text_of = np.searchsorted(begin, low, "right") - 1
            texts = np.arange(part.num_rows + 1)
            spans = _lists(np.searchsorted(text_of, texts), pa.StructArray.from_arrays(
                [pa.array(low - begin[text_of]), pa.array(high - begin[text_of])], fields=list(_SPAN)))
            text_at = np.searchsorted(begin, places, "right") - 1
            pairs = np.unique((text_at << 32) | windows)
            owner, window = pairs >> 32, pairs & 0xFFFFFFFF
            count = np.diff(wanted.first_item)[window]
            within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            pairs = np.unique((np.repeat(owner, count) << 32)
                              | wanted.items[within + np.repeat(wanted.first_item[:-1][window], count)])
            items = _lists(np.searchsorted(pairs >> 32, texts), names.take(pa.array(pairs & 0xFFFFFFFF)))
            opens, size = shard.longest(wanted, places, windows)
            order = np.lexsort((size, places[opens]))
            opens, size = opens[order], size[order]
            text_of = text_at[opens]
            matches = _lists(np.searchsorted(text_of, texts), pa.StructArray.from_arrays([
                pa.array([wanted.ids[s] for s in wanted.section_of[windows[opens]].tolist()], pa.string()),
                pa.array(wanted.word_of[windows[opens]]), pa.array(places[opens] - begin[text_of]),
                pa.array(size)], fields=list(_MATCH)))
            yield named(part, pa.array(np.diff(first)), spans, items, matches)
    return run


def item_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase),
                                F.lit(f"({WORDS})"), F.lit(1))


def sections(benchmark: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """``id``, ``begin`` (a word) and ``body`` of sections of items: their words, each window in one of them."""
    split = benchmark.select(F.col(quoted(key)).cast("string").alias("id"), item_words(F.col(quoted(text))).alias("w"))
    split = split.where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(SECTION))
    return split.select("id", "w", F.explode(starts).alias("begin")).select(
        "id", "begin", F.array_join(F.slice("w", F.col("begin") + 1, SECTION + window - 1), " ").alias("body"))


def search(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
           item_text: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """``df`` without its text (unless ``keep_text``), with ``n_words``, ``n_hit``, ``items`` (those found, in
    order) and ``matches`` of each row."""
    spark = df.sparkSession
    pieces = materialize(sections(benchmark, item, item_text, window), "sections")
    total = pieces.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, -(-int(total) // PART))
    out, found = df, []
    for k in range(parts):
        rows = pieces.where(F.pmod(F.xxhash64("id", "begin", "body"), F.lit(parts)) == k).orderBy(
            "id", "begin", "body").collect()  # about PART bytes
        wanted = Wanted([r["id"] for r in rows], [r["begin"] for r in rows], [r["body"] for r in rows], window)
        before = len(out.columns) - (not (keep_text or parts > 1))
        out = beside(out, text, _searched(spark.sparkContext.broadcast(wanted)), _ADDED, keep_text or parts > 1)
        found.append(out.columns[before:])
        if parts > 1:
            out = materialize(out, "searched")  # one part is in the tasks at a time
    names = [fresh(df, name) for name in ("n_words", "n_hit", "items", "matches")]
    hit = F.concat(*[F.col(quoted(c[1])) for c in found])
    if parts == 1:
        n_hit = F.aggregate(hit, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    else:
        n_hit = F.size(F.array_distinct(F.flatten(F.transform(hit, lambda s: F.sequence(s["start"], s["end"] - 1))))).cast("long")
    made = [F.col(quoted(found[0][0])), n_hit,
            F.array_sort(F.array_distinct(F.concat(*[F.col(quoted(c[2])) for c in found]))),
            F.array_sort(F.concat(*[F.col(quoted(c[3])) for c in found]),
                         lambda x, y: F.when(x["word"] < y["word"], -1).when(x["word"] > y["word"], 1).otherwise(0))]
    kept = [c for c in df.columns if keep_text or c != text]
    return out.select(*map(quoted, kept), *[m.alias(n) for m, n in zip(made, names)])


def decontaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` without any word inside a verbatim match with the benchmark."""
    searched = search(df, benchmark, text, keep_text=True, **options)
    hit = searched.columns[len(df.columns) + 1]
    return searched.where(F.col(quoted(hit)) == 0).select(*map(quoted, df.columns))
