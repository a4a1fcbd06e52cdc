"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ascending list of the ``K`` smallest distinct hashes of a text's shingles
(five words).  Sketches of parts merge into that of the whole, and two of them
estimate resemblance, containment and the number of distinct shingles; a text with at most
``K`` distinct shingles is held exactly.

Undefined cases: a null text counts as empty; a text without words has an empty sketch; two
empty sketches resemble each other fully, an empty and another one not at all, and the empty
one is contained in any; a text of one to four words has one shingle; equal texts have equal
sketches, whatever the row.  Documents follow each other by descending key; rows of one key
are ordered by a hash of the text and the text, a null key comes last, and the document after
the last is the first (of a single document: itself).  An empty table gives no rows.
"""

from __future__ import annotations

import binascii
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm import hashing
from factorloom.llm.frames import beside, named, quoted, slices

K = 128


def bottom(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sketch of each text."""
    hashes, first = hashing.text_shingles(texts)
    hashes = hashes.view(np.int64)
    return [np.unique(hashes[low:high])[:k] for low, high in zip(first[:-1].tolist(), first[1:].tolist())]


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated resemblance of two sketches."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    again = both[1:][both[1:] == both[:-1]]  # in both, as each is distinct
    union = np.concatenate((both[:1], both[1:][both[1:] != both[:-1]]))[:k]
    return float(np.count_nonzero(again <= union[-1]) / len(union))


def text_form(sketch: np.ndarray) -> str:
    """Base 64 of the big-endian hashes."""
    return binascii.b2a_base64(sketch.astype(">i8").tobytes(), newline=False).decode()


def _sketched(k: int):
    def run(batches):
        for part in slices(batches, 0, 2 << 20):
            yield named(part, pa.array(bottom(part.column(0), k), pa.list_(pa.int64())))
    return run


def sketches(df: DataFrame, text: str = "text", k: int = K, sketch: str = "sketch") -> DataFrame:
    """``df`` without its text, with the sketch of each."""
    return beside(df, text, _sketched(k), {sketch: "array<bigint>"})


def merge(df: DataFrame, by: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """The sketch of each group's parts together.

    Equal hashes combine before the first shuffle; of what remains each task passes on
    only its ``k`` smallest of a group, so a group of any size reaches the last task as a
    few times ``k`` numbers.
    """
    rows = df.select(F.col(quoted(by)).alias("by"), F.explode(quoted(sketch)).alias("h")).groupBy("by", "h").agg(
        F.lit(1).alias("one"))
    smallest = F.row_number().over(Window.partitionBy("by").orderBy("h"))
    ranked = rows.withColumn("r", smallest).where(F.col("r") <= int(k))
    return ranked.groupBy("by").agg(F.sort_array(F.collect_list("h")).alias(sketch)).withColumnRenamed("by", by)


def _union(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = _union(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of ``a``'s shingles that ``b`` has."""
    own = F.array_intersect(_union(a, b, k), a)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.coalesce(F.try_divide(F.size(F.array_intersect(own, b)).cast("double"), F.size(own)), F.lit(0.0)))


def distinct(sketch: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(sketch, k).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / share)


def _with_next(k: int):
    """Rows of a range in order; the last one of it, a copy of the next range's first, only follows."""
    def finished(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[1] for r in rows]
        edited = []
        for text, following in zip(texts, texts[1:]):
            half = len(text) // 2
            edited.append(text[:len(text) - half] + following[:half])
        own, other = bottom(pa.array(texts, pa.large_string()), k), bottom(pa.array(edited, pa.large_string()), k)
        n = len(edited)
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows[:n]], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([text_form(s) for s in own[:n]], pa.string()), pa.array([text_form(s) for s in other], pa.string()),
            pa.array([likeness(a, b, k) for a, b in zip(own, other)], pa.float64()),
            pa.array([likeness(a, b, k) for a, b in zip(own, own[1:])], pa.float64())], _NAMES)

    def run(batches):
        waiting = []
        for part in slices(batches, 1, 2 << 20):
            rows = waiting + list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
            if len(rows) > 1:
                yield finished(rows)
            waiting = rows[-1:]
    return run


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edited_neighbours(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text, of the text with its last half replaced by the beginning
    of the next document, and their likeness.

    Documents are dealt to ranges of the key, cut at quantiles, one range to a task, so a text is
    shuffled once.  A range also gets the first document of the next range: one document
    for each task, the only thing copied.  Cuts and first keys are as many as tasks.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    keys = df.select(order.alias("order_"))
    shares = [(i + 1) / parts for i in range(parts - 1)]
    cuts = (keys.select(F.percentile_approx("order_", shares, 20 * parts)).first()[0] or []) if shares else []
    cuts = sorted(set(cuts), reverse=True)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]

    def range_of(value: Column) -> Column:
        """How many cuts lie above a value, by halving."""
        if not cuts:
            return F.lit(0)
        edges = F.array(*[F.lit(c).cast("long") for c in cuts])
        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(
            (at + s <= len(cuts)) & (F.get(edges, at + s - 1) > value), at + s).otherwise(at))

    firsts = sorted((r["range_"], r["order_"]) for r in keys.groupBy(range_of(F.col("order_")).alias("range_"))
                    .agg(F.max("order_").alias("order_")).collect())
    targets = [(here, following[1]) for (here, _), following in zip(firsts, firsts[1:] + firsts[:1])]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("doc_id"), body.alias("body"), order.alias("order_"),
                     F.xxhash64(body).alias("tie_"))
    heads = spark.createDataFrame(targets, "range_ int, order_ long")  # a row for each task
    heads = (rows.join(F.broadcast(heads), "order_").groupBy("range_")
             .agg(F.min(F.struct("tie_", "body", "doc_id", "order_")).alias("one"))
             .select("one.doc_id", "one.body", "one.order_", "one.tie_", "range_", F.lit(True).alias("copy_")))
    dealt = rows.withColumns({"range_": range_of(F.col("order_")), "copy_": F.lit(False)}).unionByName(heads)
    ordered = (dealt.repartitionById(parts, F.col("range_"))
               .sortWithinPartitions("copy_", F.desc("order_"), "tie_", "body").select("doc_id", "body"))
    return ordered.mapInArrow(_with_next(k), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                              "edited_fingerprint string, near_edited double, near_next double")
