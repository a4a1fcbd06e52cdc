"""Toxicity by multiple-instance learning.

A text is a bag of sentences.  A sentence has the probability p = sigmoid(b + sum of the
weights of its words and word beginnings); a text is toxic with the noisy-or
1 - prod(1 - p).  Weights are learned from text labels alone, then point at the sentences
that offend.

Fitting reads a bounded sample of labelled texts (``MAX_LABELLED``, those with the smallest
hash of the key); scoring reads every text whole.  Features are hashed to ``BUCKETS``
places; the fit keeps at most ``MAX_FEATURES`` of those that occur in two or more toxic
texts and mostly there, so the model is bounded.  Each round runs some epochs in every
partition of the sample and averages the weights, by how often a part has the feature.

Undefined cases: a null or empty text, or one without words, has no sentence and scores 0;
without toxic labels every score is near 0; null labels and keys are not learned from; a
key labelled twice is toxic if any of its labels says so; repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm import hashing
from factorloom.llm.frames import beside, named, slices
from factorloom.session import materialize

MAX_LABELLED = 20_000
BUCKETS = 1 << 22
MAX_CANDIDATES = 1 << 18
MAX_FEATURES = 1 << 15
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
PARTS = 4
ROUNDS = 4
EPOCHS = 60
START_BIAS = -9.0
DECAY = 0.05           # of each weight, against the sum over texts

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """``places`` (a row of buckets for each word), the sentence of each word, the first
    sentence of each text (one entry more), the byte where each sentence starts, bytes."""
    hashes, first, starts, (data, offsets) = hashing.words(texts)
    lengths = _lengths(data, starts, offsets)
    rows = [hashes]
    for k in PREFIXES:
        rows.append(hashing.mix(hashing.token_hashes(data, starts, np.minimum(lengths, k)) + np.uint64(k)))
    places = (np.stack(rows) >> np.uint64(42)).astype(np.int32)
    ends = np.cumsum(_END[data], dtype=np.int64)[starts] if len(starts) else np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    new = np.ones(len(starts), bool)
    new[1:] = (ends[1:] != ends[:-1]) | (text_of[1:] != text_of[:-1])
    sentence = np.cumsum(new) - 1
    opening = np.flatnonzero(new)
    first_sentence = np.searchsorted(opening, first)
    return places, sentence, first_sentence, starts[opening], (data, offsets)


def _lengths(data: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of each word, as far as the longest prefix needs them."""
    most = max(PREFIXES)
    following = np.append(starts[1:], len(data))
    bound = np.minimum(following, offsets[np.searchsorted(offsets, starts, "right")] if len(starts) else 0)
    lengths = np.zeros(len(starts), np.int64)
    going = np.ones(len(starts), bool)
    for k in range(most):
        at = starts + k
        going &= (at < bound) & hashing._WORD[data[np.minimum(at, max(len(data) - 1, 0))]]
        lengths += going
    return lengths


def labelled(df: DataFrame, labels: DataFrame, text: str, key: str, label: str,
             learn: Column | None = None) -> DataFrame:
    """``id``, ``body``, ``toxic`` of the bounded sample, as a table in the shared folder."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.where(learn) if learn is not None else known
    some = (known.groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
            .orderBy(F.xxhash64(F.col("id"), F.lit(11)), "id").limit(MAX_LABELLED))
    some = materialize(some, "labels")  # at most MAX_LABELLED short rows, so it may be broadcast
    texts = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = texts.join(F.broadcast(some), "id").repartition(PARTS, F.xxhash64("id"))
    return materialize(rows.sortWithinPartitions("id", "body"), "sample")


def _toxic_counts(batches):
    counts = np.zeros(BUCKETS, np.int32)
    for part in slices(batches, 0):
        places, sentence, first, _, _ = features(part.column(0))
        text_of = np.searchsorted(first, sentence, "right") - 1
        pairs = np.unique((text_of.astype(np.int64) << 22) | places.ravel().reshape(places.shape))
        counts += np.bincount(pairs & (BUCKETS - 1), minlength=BUCKETS).astype(np.int32)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], ["place", "n"])


def _candidate_counts(candidates: np.ndarray):
    def run(batches):
        index = np.full(BUCKETS, -1, np.int32)
        index[candidates] = np.arange(len(candidates), dtype=np.int32)
        counts, texts = np.zeros(len(candidates), np.int32), 0
        for part in slices(batches, 0):
            places, sentence, first, _, _ = features(part.column(0))
            text_of = np.searchsorted(first, sentence, "right") - 1
            known = index[places]
            at = known >= 0
            pairs = np.unique((np.broadcast_to(text_of, places.shape)[at].astype(np.int64) << 22) | known[at])
            counts += np.bincount(pairs & (BUCKETS - 1), minlength=len(candidates)).astype(np.int32)
            texts += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary()), pa.array([texts])],
                                         ["counts", "texts"])
    return run


def _bags(chosen: np.ndarray):
    """For each text: its label, its sentences, and (sentence, feature) of what is chosen."""
    def run(batches):
        index = np.full(BUCKETS, -1, np.int32)
        index[chosen] = np.arange(len(chosen), dtype=np.int32)
        for part in slices(batches, 0):
            places, sentence, first, _, _ = features(part.column(0))
            known = index[places]
            at = known >= 0
            held = np.broadcast_to(sentence, places.shape)[at]
            which = known[at]
            order = np.argsort(held, kind="stable")
            held, which = held[order], which[order]
            cuts = np.searchsorted(held, first)
            rows = range(part.num_rows)
            yield pa.RecordBatch.from_arrays([
                part.column(1).cast(pa.int32()), pa.array(np.diff(first).astype(np.int32)),
                pa.array([(held[cuts[k]:cuts[k + 1]] - first[k]).astype(np.int32).tobytes() for k in rows], pa.binary()),
                pa.array([which[cuts[k]:cuts[k + 1]].tobytes() for k in rows], pa.binary())],
                ["toxic", "sentences", "held", "which"])
    return run


def _epochs(weights: np.ndarray, bias: float):
    """Some epochs of full-batch adaptive gradient steps on one partition's bags."""
    def run(batches):
        toxic, sentences, held, which = [], [], [], []
        for b in batches:
            toxic.append(b.column(0).to_numpy(zero_copy_only=False))
            sentences.append(b.column(1).to_numpy(zero_copy_only=False))
            held += [np.frombuffer(x, np.int32) for x in b.column(2).to_pylist()]
            which += [np.frombuffer(x, np.int32) for x in b.column(3).to_pylist()]
        w, b0 = weights.astype(np.float64), bias
        texts = sum(map(len, toxic))
        if texts:
            y = np.concatenate(toxic).astype(float)
            n = np.concatenate(sentences).astype(np.int64)
            first = np.concatenate(([0], np.cumsum(n)))
            at = np.concatenate([h + f for h, f in zip(held, first)]).astype(np.int64)
            col = np.concatenate(which)
            text_of = np.repeat(np.arange(texts), n)
            seen = np.bincount(col, minlength=len(w)).astype(float)
            decay = DECAY * (seen > 0)
            m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
            for step in range(1, EPOCHS + 1):
                z = b0 + np.bincount(at, w[col], minlength=first[-1])
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                clean = np.minimum(np.bincount(text_of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=texts), -1e-12)
                score = -np.expm1(clean)
                slope = np.where(y > 0, (1 - score) / score, -1.0)  # of the log likelihood, for each p
                g = slope[text_of] * p
                grad = np.append(np.bincount(col, g[at], minlength=len(w)) - decay * w, g.sum()) / texts
                m = 0.9 * m + 0.1 * grad
                v = 0.99 * v + 0.01 * grad ** 2
                move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
                w, b0 = w + move[:-1], b0 + move[-1]
            yield pa.RecordBatch.from_arrays([
                pa.array([np.append(w, b0).tobytes()], pa.binary()),
                pa.array([np.append(seen, texts).tobytes()], pa.binary())], ["weights", "seen"])
    return run


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
        learn: Column | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, weights and bias; at most ``MAX_FEATURES`` numbers reach the driver."""
    sample = labelled(df, labels, text, key, label, learn)
    counted = (sample.where("toxic = 1").select("body").mapInArrow(_toxic_counts, "place int, n int")
               .groupBy("place").agg(F.sum("n").alias("n")).where("n > 1")
               .orderBy(F.desc("n"), "place").limit(MAX_CANDIDATES)
               .toArrow())
    candidates = counted["place"].to_numpy()
    toxic = counted["n"].to_numpy().astype(float)
    clean, cleans = np.zeros(len(candidates)), 0
    for row in (sample.where("toxic = 0").select("body")
                .mapInArrow(_candidate_counts(candidates), "counts binary, texts long").collect()):
        clean += np.frombuffer(row["counts"], np.int32)
        cleans += row["texts"]
    toxics = max(sample.where("toxic = 1").count(), 1)
    lift = np.log((toxic + 0.5) / (toxics + 1)) - np.log((clean + 0.5) / (cleans + 1))
    gain = np.where(lift > 1.0, toxic * lift, 0)
    best = np.argsort(-gain, kind="stable")[:MAX_FEATURES]
    best = best[gain[best] > 0]
    chosen = candidates[best].astype(np.int32)
    weights, bias = np.minimum(lift[best], 4) * 0.5, START_BIAS
    bags = materialize(sample.select("body", "toxic").mapInArrow(
        _bags(chosen), "toxic int, sentences int, held binary, which binary"), "bags")
    for _ in range(ROUNDS):
        parts = bags.mapInArrow(_epochs(weights, bias), "weights binary, seen binary").collect()
        if not parts:
            break
        seen = [np.frombuffer(r["seen"], np.float64) for r in parts]
        total = np.maximum(sum(seen), 1)  # a part speaks for a feature as often as it has it
        mean = sum(np.frombuffer(r["weights"], np.float64) * k for r, k in zip(parts, seen)) / total
        weights, bias = mean[:-1], float(mean[-1])
    return chosen, weights, bias


def _scored(places: np.ndarray, weights: np.ndarray, bias: float, threshold: float):
    def run(batches):
        table = np.zeros(BUCKETS, np.float32)
        table[places] = weights
        for part in slices(batches, 0):
            found, sentence, first, begins, (data, offsets) = features(part.column(0))
            z = bias + np.bincount(sentence, table[found].sum(axis=0), minlength=first[-1])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            logs = np.concatenate(([0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))))
            score = np.clip(-np.expm1(logs[first[1:]] - logs[first[:-1]]), 0, 1)
            bad = np.flatnonzero(p >= threshold)
            text_of = np.searchsorted(first, bad, "right") - 1
            chars = np.cumsum((data & 0xC0) != 0x80)  # characters up to and with each byte
            until = np.append(begins[1:], len(data))[bad]
            until = np.minimum(until, offsets[text_of + 1])
            base = np.concatenate(([0], chars))[offsets[text_of]]
            low = np.concatenate(([0], chars))[begins[bad]] - base
            high = np.concatenate(([0], chars))[until] - base
            cuts = np.searchsorted(bad, first).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(
                [pa.array(low.astype(np.int64)), pa.array(high.astype(np.int64)), pa.array(p[bad])],
                ["start", "end", "score"]))
            yield named(part, pa.array(score), spans)
    return run


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text",
          score: str = "score", spans: str = "offending", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without its text, with the score of each text and its offending sentences
    (``start`` and ``end`` in characters of the lower-cased text, ``score``)."""
    kinds = {score: "double", spans: "array<struct<start:bigint,end:bigint,score:double>>"}
    return beside(df, text, _scored(*model, threshold), kinds)
