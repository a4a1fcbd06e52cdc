"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

The weight of a shingle (five words) in a text is its count there times
ln(1 + texts / document frequency), where a shingle in fewer than one of ``RARE`` texts counts as if it
were in one of ``RARE``.  So only frequencies of frequent shingles matter, of which there are at most ``RARE``
times as many as a text has on average, however many texts there are; they are counted exactly:
hashed counters, which are never too low, tell which shingles may be frequent, and those are counted
themselves.  Consistent weighted sampling gives a text ``HASHES`` samples, and two texts agree in a
sample with the probability of their weighted Jaccard similarity.  Samples are banded; texts that
share a band are compared by the weighted Jaccard similarity of the whole texts, with the same
weights, and linked from ``THRESHOLD`` on.

Equal word sequences are one content, known by a digest of its words, from the start; copies are never
paired.  Contents that share a bucket are first compared by their samples alone; a large bucket is
divided into blocks, and every two blocks are compared in a run of their own.  Only of pairs whose
samples agree enough, that are not joined yet and share no earlier band, do the whole texts go
along, once for each such run; most alike pairs are compared first and those that links already join
are skipped.  Bands are done in two rounds, so that what the first ones join travels no more.  No
bucket is cut short, and a task holds two blocks or some small buckets.

Undefined cases: a null text counts as empty; texts without words are equal and one class; a text of
one to four words has one shingle; different texts that share an id are different contents, and rows
without an id are members of classes like others; a class is named by its smallest id, and by null if
it has none; repeated rows are copies.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm import hashing
from factorloom.llm.frames import beside, components, fresh, named, quoted, slices
from factorloom.session import materialize

WIDTH = 1 << 20           # counters that tell which shingles may be frequent
RARE = 1024
HASHES, BAND_ROWS = 64, 4
THRESHOLD = 0.8
SIEVE = 36                # of 64 samples; a pair at the threshold has 51, and 36 but once in 300,000
BLOCK = 512
TOGETHER = 4096, 512      # members of small buckets in a task, without and with their texts
ROUNDS = ((0, 4), (4, 16))  # bands
CACHED = 1 << 15

_SEEDS = hashing.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at n midpoints: 1 - (1 + x) exp(-x) = p, by halving."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 64.0)
    for _ in range(80):
        mid = (low + high) / 2
        below = -np.expm1(-mid) - mid * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return high


_R = _gamma_quantiles(1 << 12).astype(np.float32)
_INVERSE_R = 1 / _R
_LN_C = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)


def vectors(texts: pa.Array, digested: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingles, ascending in each text, their counts, the first of each text (one
    entry more), and if ``digested`` a digest of each text's words."""
    words, first_word, starts, body = hashing.words(texts)
    digests = hashing.word_digests(first_word, starts, body) if digested else []
    found, first = hashing.shingles(words, first_word)
    own, counts = [], []
    for k in range(len(first) - 1):
        values, n = np.unique(found[first[k]:first[k + 1]], return_counts=True)
        own.append(values)
        counts.append(n)
    begins = np.concatenate(([0], np.cumsum([len(v) for v in own], dtype=np.int64)))
    if not own:
        return found, np.zeros(0, np.int64), begins, digests
    return np.concatenate(own), np.concatenate(counts), begins, digests


@dataclass(frozen=True)
class Weights:
    """The weights of frequent shingles (ascending), and that of all others."""

    shingles: np.ndarray
    values: np.ndarray
    other: float

    def of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(shingles), self.other, np.float32)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[at] == shingles, self.values[at], np.float32(self.other)).astype(np.float32)


def _counters(batches):
    total, texts = np.zeros(WIDTH, np.int64), 0
    for part in slices(batches, 0):
        found, _, _, _ = vectors(part.column(0))
        total += np.bincount(found & np.uint64(WIDTH - 1), minlength=WIDTH)
        texts += part.num_rows
    parts = np.split(total, 64)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.arange(64, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary()),
        pa.array([texts] + [0] * 63, pa.int64())], ["part", "counts", "texts"])


def _added(group: pa.Table) -> pa.Table:
    total = np.zeros(WIDTH // 64, np.int64)
    for x in group["counts"]:
        total += np.frombuffer(x.as_buffer(), np.int64)
    return pa.table({"part": group["part"][:1], "counts": pa.array([total.tobytes()], pa.binary()),
                     "texts": pa.array([sum(group["texts"].to_pylist())], pa.int64())})


def _counted(full: np.ndarray):
    """Document counts of the shingles whose counter is full."""
    def run(batches):
        for part in slices(batches, 0):
            found, _, _, _ = vectors(part.column(0))
            values, n = np.unique(found[full[found & np.uint64(WIDTH - 1)]], return_counts=True)
            if len(values):
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["shingle", "n"])
    return run


def inverse_frequencies(texts: DataFrame) -> Weights:
    """Weights from the document frequencies over all rows of a one-column frame."""
    layout = "part int, counts binary, texts long"
    parts = texts.mapInArrow(_counters, layout).groupBy("part").applyInArrow(_added, layout).collect()
    counters, n = np.zeros(WIDTH, np.int64), 0
    for row in parts:
        size = WIDTH // 64
        counters[row["part"] * size:(row["part"] + 1) * size] = np.frombuffer(row["counts"], np.int64)
        n += row["texts"]
    full = counters * RARE >= max(n, 1)
    counted = texts.mapInArrow(_counted(full), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") * RARE >= n).toArrow()  # at most RARE times the shingles of a mean text
    shingles, counts = rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(shingles)
    return Weights(shingles[order], np.log1p(n / counts[order]).astype(np.float32), float(np.log1p(RARE)))


def samples(shingles: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``HASHES`` consistent weighted samples of each text that has shingles."""
    filled = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(filled), HASHES), np.uint64)
    ln_s = np.log(weights).astype(np.float32)
    low = 0
    while low < len(filled):  # a few texts at a time, so that all arrays stay in the cache
        high = int(np.searchsorted(first[filled + 1], first[filled[low]] + CACHED, "right"))
        high = max(high, low + 1)
        begin, end = first[filled[low]], first[filled[high - 1] + 1]
        starts = first[filled[low:high]] - begin
        count = np.diff(np.append(starts, end - begin))
        part, logs = shingles[begin:end], ln_s[begin:end]
        for i in range(HASHES):
            x = part * _SEEDS[i]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            place = (x >> np.uint64(52)).view(np.int64)
            beta = ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32)
            beta *= np.float32(1 / 65536)
            t = np.floor(logs * _INVERSE_R[place] + beta)
            a = _LN_C[((x >> np.uint64(36)) & np.uint64(0xFFFF)).view(np.int64)]
            a -= _R[place] * (t - beta + 1)
            least = np.minimum.reduceat(a, starts)
            at = np.flatnonzero(a == np.repeat(least, count))
            at = at[np.searchsorted(at, starts)]
            out[low:high, i] = part[at] ^ (t[at].astype(np.int64).view(np.uint64) * np.uint64(0xA24BAED4963EE407))
        low = high
    return hashing.mix(out)


def bands(sampled: np.ndarray) -> np.ndarray:
    """A key for each band, different between bands."""
    count = HASHES // BAND_ROWS
    keys = np.empty((len(sampled), count), np.uint64)
    for b in range(count):
        key = np.full(len(sampled), b + 1, np.uint64)
        for column in range(b * BAND_ROWS, (b + 1) * BAND_ROWS):
            key = hashing.mix(key * np.uint64(31) + sampled[:, column])
        keys[:, b] = key
    return keys.view(np.int64)


def _signed(weights: Weights):
    def run(batches):
        for part in slices(batches, 1, 2 << 20):
            found, counts, first, digests = vectors(part.column(1), True)
            sampled = samples(found, counts * weights.of(found), first)
            keys = bands(sampled)
            filled = np.diff(first) > 0
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(np.where(filled, keys.shape[1], 0)))).astype(np.int32)),
                pa.array(keys.ravel()))
            marks = np.zeros((len(filled), HASHES), "<u2")
            marks[filled] = sampled & np.uint64(0xFFFF)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(digests, pa.binary()), lists,
                 pa.array([m.tobytes() for m in marks], pa.binary())], ["id", "digest", "bands", "marks"])
    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (ascending shingles, weights)."""
    both = np.concatenate((a[0], b[0]))
    order = np.argsort(both, kind="stable")
    both, weights = both[order], np.concatenate((a[1], b[1]))[order]
    same = np.flatnonzero(both[1:] == both[:-1])
    least = np.minimum(weights[same], weights[same + 1]).sum()
    most = weights.sum() - least
    return float(least / most) if most > 0 else 1.0


def _alike(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and agreements of the pairs to compare: two members of a run (of different blocks, if it has two) that
    are not joined, agree in enough samples, and share no band before the run's."""
    band, bucket, i, j, block = (group[c].to_numpy() for c in ("band", "bucket", "i", "j", "block"))
    order = np.lexsort((j, i, bucket, band))
    band, block, two = band[order], block[order], (i != j)[order]
    runs = np.stack([x[order] for x in (bucket, i, j)])
    run = np.cumsum(np.append(0, (band[1:] != band[:-1]) | (runs[:, 1:] != runs[:, :-1]).any(axis=0)))
    marks = np.frombuffer(b"".join(group["marks"].to_pylist()), "<u2").reshape(-1, HASHES)[order]
    part = group["part"].to_numpy()[order]
    left, right, agreed = [], [], []
    for step in range(1, int(np.bincount(run).max())):
        a = np.flatnonzero((run[:-step] == run[step:]) & (part[:-step] != part[step:])
                           & (~two[:-step] | (block[:-step] != block[step:])))
        if not len(a):
            continue
        same = marks[a] == marks[a + step]
        n = same.sum(axis=1)
        fit = np.flatnonzero(n >= SIEVE)
        shared = same[fit].reshape(len(fit), HASHES // BAND_ROWS, BAND_ROWS).all(axis=2)
        fit = fit[shared.argmax(axis=1) == band[a[fit]]]
        left.append(order[a[fit]])
        right.append(order[a[fit] + step])
        agreed.append(n[fit])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([*x, none]).astype(np.int64) for x in (left, right, agreed))


_RUN = "band int, bucket long, i int, j int, block int, node long, marks binary, part long"


def _sieved(group: pa.Table) -> pa.Table:
    """The members that are to be compared with another."""
    left, right, _ = _alike(group)
    rows = group.take(pa.array(np.unique(np.concatenate((left, right)))))
    return rows.select([x.split()[0] for x in _RUN.split(", ")])


def _compared(weights: Weights, threshold: float):
    """Links between members, found by descending agreement; pairs already joined are skipped, all others are
    compared whole."""
    def run(group: pa.Table) -> pa.Table:
        left, right, agreed = _alike(group)
        nodes, sample, which = np.unique(group["node"].to_numpy(), return_index=True, return_inverse=True)
        parts = np.unique(group["part"].to_numpy(), return_inverse=True)[1]
        found, counts, first, _ = vectors(group["body"].combine_chunks().take(pa.array(sample)))
        held = (counts * weights.of(found)).astype(np.float64)
        sums = np.add.reduceat(np.append(held, 0), first[:-1])
        one, two = which[left], which[right]
        fit = np.minimum(sums[one], sums[two]) >= threshold * 0.999 * np.maximum(sums[one], sums[two])
        order = np.flatnonzero(fit)[np.argsort(-agreed[fit], kind="stable")]
        parent = list(range(int(parts.max()) + 1))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        kept = []
        for k, a, b in zip(order.tolist(), one[order].tolist(), two[order].tolist()):
            up, down = root(int(parts[left[k]])), root(int(parts[right[k]]))
            if up != down and similarity((found[first[a]:first[a + 1]], held[first[a]:first[a + 1]]),
                                         (found[first[b]:first[b + 1]], held[first[b]:first[b + 1]])) >= threshold:
                parent[down] = up
                kept.append((a, b))
        a, b = np.array(kept, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(nodes[a]), "b": pa.array(nodes[b])})
    return run


def _dealt(rows: DataFrame, small: int) -> DataFrame:
    """``rows`` with ``task``: one for each run of a divided bucket, and one for about ``small`` members of others."""
    tasks = max(1, rows.count() // small)
    few = F.pmod(F.xxhash64("band", "bucket"), F.lit(tasks))
    return rows.withColumn("task", F.when(F.col("blocks") == 1, few).otherwise(F.xxhash64("band", "bucket", "i", "j")))


def _round(members: DataFrame, bodies: DataFrame, marks: DataFrame, known: DataFrame | None, weights: Weights,
           threshold: float) -> DataFrame:
    """Links between contents that share a bucket of the round."""
    seen = marks if known is None else marks.join(known.withColumnRenamed("component", "known"), "node", "left")
    part = F.col("node") if known is None else F.coalesce("known", "node")
    here = members.join(seen.withColumn("part", part), "node")
    runs = here.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", "bucket", "blocks", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "node", "marks", "part")
    alike = materialize(_dealt(runs, TOGETHER[0]).groupBy("task").applyInArrow(_sieved, _RUN), "alike")
    whole = alike.withColumn("blocks", F.when(F.col("j") > 0, 2).otherwise(1))
    return (_dealt(whole, TOGETHER[1]).join(bodies, "node").groupBy("task")
            .applyInArrow(_compared(weights, threshold), "a long, b long"))


def contents(df: DataFrame, key: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``id``, ``digest`` and ``node`` (a number for each content) of every row, and ``node`` and ``component`` of the
    contents that have links."""
    texts = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    weights = inverse_frequencies(texts.select("body"))
    rows = materialize(texts.mapInArrow(
        _signed(weights), "id long, digest binary, bands array<bigint>, marks binary"), "signatures")
    nodes = materialize(rows.select("digest", "bands", "marks").dropDuplicates(["digest"])
                        .withColumn("node", F.monotonically_increasing_id()), "contents")
    every = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    sizes = every.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = materialize(every.join(sizes, ["band", "bucket"]).select(
        "band", "bucket", "node", blocks.alias("blocks"),
        F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block")), "members")
    shared = nodes.join(members.select("node").distinct(), "node").select("node", "digest", "marks")
    shared = materialize(shared, "shared")
    # Both sides of this join grow with the input: it moves each text once at every size.
    bodies = texts.mapInArrow(_with_digest, "digest binary, body string").hint("merge").join(
        shared.select("node", "digest"), "digest").dropDuplicates(["digest"]).select("node", "body")
    bodies = materialize(bodies, "bodies")
    links, known = [], None
    for low, high in ROUNDS:
        own = members.where((F.col("band") >= low) & (F.col("band") < high))
        links.append(materialize(_round(own, bodies, shared.select("node", "marks"), known, weights, threshold), "links"))
        known = materialize(components(reduce(DataFrame.union, links), "a", "b"), "components")
    return rows.select("id", "digest").join(nodes.select("digest", "node"), "digest"), known


def _with_digest(batches):
    for part in slices(batches, 1, 2 << 20):
        _, first, starts, body = hashing.words(part.column(1))
        yield pa.RecordBatch.from_arrays([pa.array(hashing.word_digests(first, starts, body), pa.binary()),
                                          part.column(1)], ["digest", "body"])


def _digested(batches):
    for part in slices(batches, 0, 2 << 20):
        _, first, starts, body = hashing.words(part.column(0))
        yield named(part, pa.array(hashing.word_digests(first, starts, body), pa.binary()))


def _classed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with ``part``, the content that stands for their class."""
    return rows.join(known, "node", "left").select("id", "digest", F.coalesce("component", "node").alias("part"))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id``, ``digest`` and ``class_id`` (the smallest id reachable by links) of every row."""
    rows, known = contents(df, key, text, threshold)
    member = _classed(rows, known)
    least = member.groupBy("part").agg(F.min("id").alias("class_id"))
    return member.join(least, "part").select("id", "digest", "class_id")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class: that with the smallest id, or, where no row has one, any."""
    rows, known = contents(df, key, text, threshold)
    member = _classed(rows, known)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    chosen = member.groupBy("part").agg(F.min(rank).alias("one")).select("one.id", "one.digest")
    counted = member.groupBy("id", "digest").agg(F.count("*").alias("n"))
    same = F.col("c.id").eqNullSafe(F.col("n.id")) & (F.col("c.digest") == F.col("n.digest"))
    chosen = materialize(chosen.alias("c").join(counted.alias("n"), same).select("c.id", "c.digest", "n.n"), "chosen")
    body = fresh(df, "digested_")
    tagged = beside(df.withColumn(body, F.coalesce(F.col(quoted(text)), F.lit(""))), body, _digested, {"content": "binary"})
    content = tagged.columns[-1]
    match = F.col(quoted(key)).cast("long").eqNullSafe(F.col("chosen_.id")) & (F.col(quoted(content)) == F.col("chosen_.digest"))

    def picked(which: str) -> DataFrame:
        return tagged.join(chosen.where(which).alias("chosen_"), match, "left_semi")

    once = picked("n = 1").select(*map(quoted, df.columns))
    if chosen.where("n > 1").isEmpty():
        return once
    again = picked("n > 1").withColumn(content + "k", F.col(quoted(key)).cast("long"))
    return once.union(again.dropDuplicates([content + "k", content]).select(*map(quoted, df.columns)))
