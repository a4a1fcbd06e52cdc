"""Table reading, columns made in Arrow batches, places in an order, and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.session import materialize


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores after it where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def beside(df: DataFrame, first: str, run, added: dict[str, str], keep: bool = False) -> DataFrame:
    """``df`` with columns that ``run`` makes from column ``first``, which stays if ``keep``.

    ``run`` gets Arrow batches with ``first`` as first column and the others after it, and
    yields the others and the new ones, named as ``named`` does.  Columns have internal
    names on the way, so they may have any; a new one whose name is taken gets another.
    """
    rest = [c for c in df.columns if keep or c != first]
    ready = df.select(F.col(quoted(first)).alias("f"),
                      *[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(rest)])
    kinds = [f"c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(rest)]
    kinds += [f"a{k} {kind}" for k, kind in enumerate(added.values())]
    out = ready.mapInArrow(run, ", ".join(kinds))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(rest)],
                      *[F.col(f"a{k}").alias(fresh(df.select(*map(quoted, rest)) if rest else df.select(), name))
                        for k, name in enumerate(added)])


def named(part, *new):
    """A batch of the columns of ``part`` but the first, and the new ones."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([*part.columns[1:], *new],
                                      [*part.schema.names[1:], *[f"a{k}" for k in range(len(new))]])


def placed(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``pos``, the place of a row in its ``tree`` (a column) by ``order``, and the tree's ``size``.

    One shuffle by ranges, which divides trees of any size, and counts per range; places do not
    depend on the ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (df.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
               .withColumn("at_", F.monotonically_increasing_id()))
    rows = materialize(ordered, "placed").withColumn("part_", F.shiftright("at_", 33))
    runs = rows.groupBy("tree", "part_").agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    whole = Window.partitionBy("tree")
    runs = materialize(runs.select(
        "tree", "part_", "first_", F.sum("n_").over(whole).alias("size"),
        (F.sum("n_").over(whole.orderBy("part_")) - F.col("n_")).alias("before_")), "runs")
    return (rows.join(runs, ["tree", "part_"])
            .withColumn("pos", F.col("at_") - F.col("first_") + F.col("before_"))
            .drop("at_", "part_", "first_", "before_"))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that has a link.

    Alternates large and small stars until the links no longer change: each round hangs
    every neighbour of a node on the smallest one, so the depth halves.  Rounds are
    written to the shared folder; the driver sees a count and a checksum.  The smallest
    neighbours are written, too: both sides of each join on the node are then shuffled
    scans, which adaptive execution can split where one node holds many links.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                        .where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"))
                            .select("u", F.least("u", "m").alias("m")), "links")
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = materialize(large.where("u <> v").distinct(), "links")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "links")
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def slices(batches, texts: int, limit: int = 4 << 20):
    """Parts of Arrow batches with about ``limit`` bytes in column ``texts``, in order."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            base = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(low, high - low)
            low = high
