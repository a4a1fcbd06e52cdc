"""Cut oversized series into ranges so that no task holds a whole one.

A window over (exchange, security) puts all rows of one security into one task.
That is right for ordinary securities and fatal for one that holds a large share
of the data.  ``split_hot_series`` finds the securities with more than
``split_rows`` rows and cuts each into ranges of ``chunk_rows`` rows by the place
of a row in its series, whatever days these rows are of.  Every range gets a copy
of the ``halo_rows`` rows before it, which rolling frames need.  Windows are then
partitioned by (exchange, security, chunk) and halo rows are dropped from the
result, which equals the unsplit one.

The place of a row is found without holding a series in one task: rows of
oversized series are dealt to ranges of their order and written once; a row's
place is the size of the earlier ranges plus its place in its own.  Rows that the
order does not tell apart are told apart by a hash of all their columns, in split
and whole series alike when the order is the date alone.

Costs: the counts per security, unless the caller has them, of which only the oversized
are written, then, if there are any, one pass that writes their rows.  When there is none (the normal
case) the plan is that of a plain window: the data is shuffled once, by security,
and later steps per security reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.packed_order import PackedOrder
from factorloom.schema import SERIES_KEYS
from factorloom.session import materialize

SPLIT_ROWS = 20_000_000
CHUNK_ROWS = 5_000_000
RANGE_ROWS = 100_000
TIE = "_tie"


def order_key(df: DataFrame, order, columns):
    """One sortable expression for an ordering column list of ``df``.

    A date alone is followed by a hash of ``columns``, those that the result
    takes, so that rows of one day have a fixed order; both fit into a long,
    which aggregates by hash, as does a ``PackedOrder``.  Other orders of several
    columns are compared as a struct, for which rows are sorted.
    """
    if isinstance(order, PackedOrder):
        return order.key(df)
    if len(order) > 1:
        return F.struct(*order)
    if dict(df.dtypes).get(order[0]) != "date":
        return F.col(order[0])
    tie = F.xxhash64(*columns).bitwiseAND(F.lit((1 << 40) - 1))
    return F.shiftleft(F.unix_date(order[0]).cast("long"), 40) + tie


def window_order(order) -> list[str]:
    """The order of a series in windows over the result of ``split_hot_series``."""
    return [*order, TIE] if len(order) == 1 else list(order)


def split_hot_series(prices: DataFrame, *, halo_rows: int, carry: str | None = None,
                     order=("datadate",), keys=SERIES_KEYS,
                     split_rows: int | None = SPLIT_ROWS, chunk_rows: int = CHUNK_ROWS,
                     sizes: DataFrame | None = None) -> DataFrame:
    """Add ``chunk``, ``is_halo``, ``carried`` and ``offset``; repeat rows that serve as halo.

    ``offset`` is the number of rows of the series before the first one of the
    chunk, halo included; ``carried`` is the last non-null value of ``carry``
    among them.  With the date as the only order there is a column ``_tie``,
    too.  ``sizes`` has ``n_rows`` of every series where that is known (``DailyStore``
    has it), at least as many as there are; else they are counted.
    ``split_rows=None`` skips the search, for callers that know their series to be
    short (one row per security and day).
    """
    keys, columns = list(keys), list(prices.columns)
    if len(order) == 1:
        prices = prices.withColumn(TIE, F.xxhash64(*columns))
    oversized = None
    if split_rows is not None:
        counted = (prices.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")) if sizes is None
                   else sizes.select(*keys, F.col("n_rows").alias("_rows")))
        oversized = materialize(counted.filter(F.col("_rows") > split_rows), "oversized-series")
        total = oversized.agg(F.sum("_rows")).first()[0]
    if oversized is None or not total:
        return prices.withColumns({"chunk": F.lit(0).cast("long"), "is_halo": F.lit(False),
                                   "carried": F.lit(None).cast("double"),
                                   "offset": F.lit(0).cast("long")})
    oversized = oversized.select(*keys)
    placed = materialize(_placed(prices.join(oversized, keys, "left_semi"), keys, order, columns,
                                 _ranges(prices.sparkSession, total, chunk_rows)), "placed-series")
    last = F.floor((F.col("_place") + halo_rows) / chunk_rows)
    spread = placed.withColumn("_own", F.floor(F.col("_place") / chunk_rows)).withColumn(
        "chunk", F.explode(F.sequence("_own", last)))
    begin = F.greatest(F.col("chunk") * chunk_rows - halo_rows, F.lit(0))
    hot = (spread.join(_carried(placed, keys, carry, halo_rows, chunk_rows), [*keys, "chunk"])
           .select(*prices.columns, "chunk", (F.col("chunk") > F.col("_own")).alias("is_halo"),
                   "carried", begin.cast("long").alias("offset")))
    cold = prices.join(oversized, keys, "left_anti").select(
        *prices.columns, F.lit(0).cast("long").alias("chunk"), F.lit(False).alias("is_halo"),
        F.lit(None).cast("double").alias("carried"), F.lit(0).cast("long").alias("offset"))
    return cold.unionByName(hot)


def _ranges(spark, total: int, chunk_rows: int) -> int:
    """How many ranges ``total`` rows are dealt to: of about a chunk each, but short chunks share
    one, because every range costs a task and a file.  Places do not depend on it."""
    enough = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    return max(2, min(-(-total // chunk_rows), enough))


def _placed(hot: DataFrame, keys, order, columns, ranges: int) -> DataFrame:
    """Add ``_place``, counted from 0 in each series."""
    sort = [*keys, *order, F.xxhash64(*columns)]
    dealt = materialize(hot.repartitionByRange(ranges, *sort)
                        .withColumn("_range", F.spark_partition_id()), "hot-series")
    sizes = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_held"))
    earlier = (Window.partitionBy(*keys).orderBy("_range")
               .rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select(*keys, "_range",
                          F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order, F.xxhash64(*columns))
    return (dealt.withColumn("_inside", F.row_number().over(inside))
            .join(before, [*keys, "_range"])
            .withColumn("_place", F.col("_before") + F.col("_inside") - 1)
            .drop("_range", "_inside", "_before"))


def _carried(placed: DataFrame, keys, carry: str | None, halo_rows: int,
             chunk_rows: int) -> DataFrame:
    """The chunks of each series, with the last value before the halo of each."""
    value = F.col(carry).cast("double") if carry else F.lit(None).cast("double")
    reached = F.floor((F.col("_place") + halo_rows) / chunk_rows) + 1
    known = (placed.filter(value.isNotNull()).groupBy(*keys, reached.alias("chunk"))
             .agg(F.max_by(value, F.col("_place")).alias("_value")))
    chunks = (placed.groupBy(*keys, F.floor(F.col("_place") / chunk_rows).alias("chunk"))
              .agg(F.lit(True).alias("_held")))
    until = (Window.partitionBy(*keys).orderBy("chunk")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (chunks.join(known, [*keys, "chunk"], "full")
            .withColumn("carried", F.last("_value", ignorenulls=True).over(until))
            .filter("_held").select(*keys, "chunk", "carried"))
