"""Quality by importance resampling.

Two generative models of hashed n-grams (tokens and pairs of tokens) are counted: one on
target text (texts labelled good) and one on all raw text.  The log weight of a text is the
log ratio of its likelihoods under them, tempered to ``LENGTH`` n-grams: the text counts as if it had
that many, so that long texts are not favoured.  Gumbel noise is added and the texts with the k largest
sums stay, which samples k texts without replacement in proportion to their weights.

Tokens are runs of letters and digits, or of other marks, with case; a token equal to the
one before it becomes a mark of repetition.  The target model reads a bounded sample of labelled
texts (``MAX_TARGET``, smallest hash of the key first); raw counts cover every text.  The
ratio of a place is (target + ``PRIOR``) / (expected + ``PRIOR``), so rare places say little.

k is given, or the number of target texts to be expected: the sum of the odds w / (1 + w) over all texts, where
a weight is multiplied by ``exp(LOG_ODDS)``, the odds for a text that nothing is known of.

Undefined cases: a null or empty text, or one without tokens, has no weight and never
stays; without target text all ratios are 0; rows with equal key and text get equal noise,
and rows that tie at the k-th place all stay; the noise comes from a hash of key and text,
so a repeated run keeps the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm import hashing
from factorloom.llm.frames import beside, fresh, named, quoted, slices
from factorloom.session import materialize

PLACES = 1 << 16
MAX_TARGET = 20_000
PRIOR = 5.0
LENGTH = 20.0
LOG_ODDS = 8.0
SEED = 17
BINS = 4096
FEW = 20_000

_CLASSES = np.full(256, 2, np.uint8)
_CLASSES[hashing._WORD] = 1
_CLASSES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x00]] = 0


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The place of each n-gram, single tokens before pairs, and the text of each."""
    found, first, _, _ = hashing.tokens(texts, _CLASSES, lower=False)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    follows = np.zeros(len(found), bool)
    follows[1:] = text_of[1:] == text_of[:-1]
    again = follows.copy()
    again[1:] &= found[1:] == found[:-1]
    found = np.where(again, np.uint64(1), found)
    pairs = hashing.mix(found[:-1] * np.uint64(3) + found[1:])[follows[1:]]
    places = np.concatenate((found, pairs)) >> np.uint64(48)
    return places.astype(np.int32), np.concatenate((text_of, text_of[follows]))


def _counts(batches):
    total = np.zeros(PLACES, np.int64)
    for part in slices(batches, 0, 2 << 20):
        total += np.bincount(grams(part.column(0))[0], minlength=PLACES)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["place", "n"])


def place_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all places over a one-column frame, combined in each task first."""
    rows = (texts.mapInArrow(_counts, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
            .toArrow())
    counts = np.zeros(PLACES)
    counts[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return counts


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
        learn: Column | None = None) -> np.ndarray:
    """The log ratio of each place."""
    good = labels.where((F.col(label) == 1) & F.col(key).isNotNull())
    good = good.where(learn) if learn is not None else good
    some = materialize(good.select(F.col(key).alias("id")).distinct()
                       .orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(MAX_TARGET), "target")
    body = df.select(F.col(key).alias("id"), F.col(text).alias("body"))
    target = place_counts(body.join(F.broadcast(some), "id", "left_semi").select("body"))  # at most MAX_TARGET ids
    raw = place_counts(body.select("body"))
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log((target + PRIOR) / (expected + PRIOR))


def _means(ratios: np.ndarray):
    def run(batches):
        for part in slices(batches, 0, 2 << 20):
            places, text_of = grams(part.column(0))
            n = np.bincount(text_of, minlength=part.num_rows)
            total = np.bincount(text_of, ratios[places], minlength=part.num_rows)
            yield named(part, pa.array(total / np.maximum(n, 1), mask=n == 0))
    return run


def score(df: DataFrame, ratios: np.ndarray, text: str = "text", key: str = "doc_id", ratio: str = "log_ratio",
          order: str = "sample_key", keep_text: bool = False) -> DataFrame:
    """``df`` with the mean log ratio and the sum of log weight and Gumbel noise."""
    ratio, order, noise = fresh(df, ratio), fresh(df, order), fresh(df, "noise")
    share = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(key), F.col(text)), 11)
    uniform = (share + F.lit(0.5)) / F.lit(2.0 ** 53)
    out = beside(df.withColumn(noise, -F.log(-F.log(uniform))), text, _means(ratios), {ratio: "double"}, keep_text)
    return out.withColumn(order, F.col(ratio) * LENGTH + F.col(noise)).drop(noise)


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column, or None if there are fewer.

    Counts in equal bins narrow the range until few values are left, so no task ever
    sorts all of them; the driver gets at most ``BINS`` counts or ``FEW`` values.
    """
    values = df.select(F.col(column).alias("v")).where("v IS NOT NULL")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if k < 1 or n < k:
        return None
    rank = k  # counted from the top of what lies in [low, high]
    while n > FEW and high > low:
        width = (high - low) / BINS
        binned = values.where(F.col("v").between(low, high)).groupBy(
            F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)).alias("bin")).agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for row in sorted(binned.collect(), key=lambda r: -r["bin"]):
            if rank <= row["n"]:
                low, high, n = row["low"], row["high"], row["n"]
                break
            rank -= row["n"]
    if high == low:
        return low
    inside = values.where(F.col("v").between(low, high)).orderBy(F.desc("v")).limit(rank).collect()
    return inside[-1]["v"]


def expected(scored: DataFrame, ratio: str = "log_ratio") -> int:
    """The number of target texts that the weights let expect; the same whatever the order of adding."""
    odds = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col(ratio) * LENGTH + LOG_ODDS)))
    return round(scored.agg(F.sum(odds.cast("decimal(18,9)"))).first()[0] or 0)


def threshold(scored: DataFrame, k: int | None = None, ratio: str = "log_ratio",
              order: str = "sample_key") -> float:
    """What the sum must reach for a text to be among the k sampled."""
    if k is None:
        k = expected(scored, ratio)
    found = kth_largest(scored, order, k)
    return float("-inf") if found is None and k > 0 else float("inf") if found is None else found


def resample(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
             k: int | None = None, kept: str = "kept", learn: Column | None = None) -> DataFrame:
    """Every row of ``df`` without its text, with its ratio, sum and whether it is sampled."""
    ratios = fit(df, labels, text, key, label, learn)
    scored = materialize(score(df, ratios, text, key), "weights")
    kept, order, ratio = fresh(scored, kept), scored.columns[-1], scored.columns[-2]
    limit = threshold(scored, k, ratio, order)
    return scored.withColumn(kept, F.coalesce(F.col(order) >= F.lit(limit), F.lit(False)))


def sampled(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
            k: int | None = None) -> DataFrame:
    """The sampled rows of ``df`` as they are.  Weights are computed twice, once for the
    k-th sum and once beside the texts, which spares a shuffle of all texts."""
    ratios = fit(df, labels, text, key, label)
    weights = materialize(score(df.select(key, text), ratios, text, key), "weights")
    limit = threshold(weights, k)
    whole = score(df, ratios, text, key, keep_text=True)
    order = whole.columns[-1]
    return whole.where(F.col(order) >= F.lit(limit)).select(*map(quoted, df.columns))
