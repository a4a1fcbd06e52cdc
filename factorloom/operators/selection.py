"""Quantiles of many columns in many groups, and rank correlations of many columns.

``group_quantiles`` narrows histograms: every (group, column) begins with the range of its
values; a round counts the values of each range in bins, combined before the shuffle, and
keeps, for every wanted place, the bin it lies in.  Bins are of equal width on a line
that is plain in one round and logarithmic in the next, so far-off values do not hold
it up.  Ranges that hold few values are finished by counting their values in order.
All groups and columns go on together, a round is one job, and what moves is counts.

``spearman_matrix`` ranks all columns of all groups from one division of
(group, column, value) into ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.ranks import correlation
from factorloom.session import materialize

BINS = 128
FEW = 5_000


def unpivoted(df: DataFrame, keys, columns) -> DataFrame:
    """``keys``, ``column`` and ``value`` of every value that is not missing."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return (df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.column", "_p.value")
            .filter(F.col("value").isNotNull() & ~F.isnan("value")))


def _scaled(value: Column, logarithmic: bool) -> Column:
    """A line on which bins are of equal width; it never turns back."""
    return F.signum(value) * F.log1p(F.abs(value)) if logarithmic else value


def _bin(value: Column, low: Column, high: Column, logarithmic: bool) -> Column:
    """The bin of a value, which does not decrease with it; halves keep the width finite."""
    v, a, b = (_scaled(x, logarithmic) / 2 for x in (value, low, high))
    share = F.coalesce(F.try_divide(v - a, b - a), F.lit(0.0))
    return F.greatest(F.lit(0), F.least(F.floor(share * BINS).cast("int"), F.lit(BINS - 1)))


def _same(keys) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"v.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])


def _binned(values: DataFrame, ranges: DataFrame, by: list[str], logarithmic: bool) -> DataFrame:
    """Counts of the values in the bins of each range, with how many values come before a bin."""
    inside = values.alias("v").join(ranges.alias("r"), _same(by)).select(
        *[F.col(f"v.{k}") for k in by], F.col("v.value").alias("value"), F.col("v.n").alias("n"),
        F.explode("r.ranges").alias("r")).filter(F.col("value").between(F.col("r.low"), F.col("r.high")))
    counted = (inside.groupBy(*by, F.col("r.low").alias("from_"), F.col("r.before").alias("before_"),
                              _bin(F.col("value"), F.col("r.low"), F.col("r.high"), logarithmic).alias("bin"))
               .agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")))
    earlier = Window.partitionBy(*by, "from_").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(*by, "low", "high", "n", (F.col("before_") + F.coalesce(
        F.sum("n").over(earlier), F.lit(0))).alias("before"))


def _counted(values: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """The values of small ranges in order, each with how many come before it."""
    inside = values.alias("v").join(ranges.alias("r"), _same(by)).select(
        *[F.col(f"v.{k}") for k in by], F.col("v.value").alias("value"), F.col("v.n").alias("n"),
        F.explode("r.ranges").alias("r")).filter(F.col("value").between(F.col("r.low"), F.col("r.high")))
    each = inside.groupBy(*by, F.col("r.low").alias("from_"), F.col("r.before").alias("before_"), "value").agg(
        F.sum("n").alias("n"))
    earlier = Window.partitionBy(*by, "from_").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*by, F.col("value").alias("low"), F.col("value").alias("high"), "n", (
        F.col("before_") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("before"))


def _hit(parts: DataFrame, places: DataFrame, by: list[str]) -> DataFrame:
    """The part (range or value) that each wanted place lies in."""
    return places.select(*by, F.explode("places").alias("place")).alias("v").join(
        parts.alias("r"), _same(by) & (F.col("v.place") >= F.col("r.before"))
        & (F.col("v.place") < F.col("r.before") + F.col("r.n"))).select(
        *[F.col(f"v.{k}") for k in by], "place", "r.low", "r.high", "r.n", "r.before")


def group_quantiles(df: DataFrame, keys, columns, probabilities=(0.25, 0.5, 0.75), few: int = FEW) -> DataFrame:
    """``keys``, ``column``, ``n`` and ``quantiles`` (linearly interpolated) of each group and column.

    Missing values do not count; a column without values in a group has no row.
    Equal values are combined first, so a value that fills a group is one row of it.
    """
    by = [*keys, "column"]
    values = materialize(unpivoted(df, keys, columns).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n")),
                         "group-values")
    probs = [float(p) for p in probabilities]
    at = [(F.col("total") - 1) * F.lit(p) for p in probs]
    places = F.array_sort(F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)])))
    sizes = values.groupBy(*by).agg(F.sum("n").alias("total"), F.min("value").alias("low"),
                                    F.max("value").alias("high"))
    todo = materialize(sizes.select(*by, "total", places.alias("places"), F.array(F.struct(
        "low", "high", F.lit(0).cast("long").alias("before"))).alias("ranges"),
        F.col("total").alias("most")), "quantile-ranges")
    settled, logarithmic = [], False
    while True:
        large = todo.filter(F.col("most") > few)
        if large.isEmpty():
            break
        # A round: places in a bin of one value, or of few, are left to the end.
        hit = materialize(_hit(_binned(values, large, by, logarithmic), large, by), "quantile-bins")
        narrowed = hit.groupBy(*by).agg(
            F.array_sort(F.collect_set("place")).alias("places"),
            F.array_distinct(F.collect_list(F.struct("low", "high", "before"))).alias("ranges"),
            F.max(F.when(F.col("low") < F.col("high"), F.col("n")).otherwise(0)).alias("most"))
        settled.append(todo.filter(F.col("most") <= few))
        totals = large.select(*by, "total")
        todo = materialize(totals.alias("v").join(narrowed.alias("r"), _same(by)).select(
            *[F.col(f"v.{k}") for k in by], "total", "places", "ranges", "most"), "quantile-ranges")
        logarithmic = not logarithmic
    settled.append(todo)
    small = reduce(DataFrame.unionByName, settled)
    found = _hit(_counted(values, small, by), small, by).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("place", "low"))).alias("value_at"))
    low, high = ([F.element_at("value_at", f(x).cast("long")) for x in at] for f in (F.floor, F.ceil))
    quantiles = F.array(*[a + (x - F.floor(x)) * (b - a) for a, b, x in zip(low, high, at)])
    return small.select(*by, "total").alias("v").join(found.alias("r"), _same(by)).select(
        *[F.col(f"v.{k}") for k in by], F.col("total").alias("n"), quantiles.alias("quantiles"))


def _ranked(values: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``value`` and its average ``rank`` within ``by``, from one division into ranges."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = materialize(values.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
                         .repartitionByRange(parts, *by, "value")
                         .withColumn("_range", F.spark_partition_id()), "value-ranges")
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.groupBy(*by, "_range").agg(F.sum("n").alias("_held")).select(
        *by, "_range", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range", *by).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return placed.alias("v").join(offsets.alias("r"), _same([*by, "_range"])).select(
        *[F.col(f"v.{k}") for k in by], F.col("v.value"),
        (F.col("r._offset") + F.col("v._inside") + (F.col("v.n") + 1) / F.lit(2.0)).alias("rank"))


def spearman_matrix(df: DataFrame, keys, columns, against: str) -> DataFrame:
    """``keys``, ``column``, ``n`` and ``spearman``: the rank correlation of every column with
    ``against`` in every group, over the rows that have both; NULL where a side is constant."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    both = materialize(
        df.select(*keys, F.col(against).cast("double").alias("y"), F.explode(pairs).alias("_p"))
        .select(*keys, "_p.column", "_p.x", "y").filter("x IS NOT NULL AND y IS NOT NULL"), "pairs")
    by = [*keys, "column", "side"]
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("value")) for s in ("x", "y")])
    ranks = materialize(_ranked(both.select(*keys, "column", F.explode(sides).alias("_s"))
                                .select(*keys, "column", "_s.*"), by), "ranks")
    out = both
    for side in ("x", "y"):
        lookup = ranks.filter(F.col("side") == side).select(*keys, "column", F.col("value").alias(side),
                                                            F.col("rank").alias(f"r{side}"))
        match = _same([*keys, "column"]) & (F.col(f"v.{side}") == F.col(f"r.{side}"))
        out = out.alias("v").join(lookup.alias("r"), match).select("v.*", f"r.r{side}")
    return out.groupBy(*keys, "column").agg(F.count(F.lit(1)).alias("n"), correlation("rx", "ry").alias("spearman"))
