"""A price panel that grows by new days without its history being read again.

What later rows need of earlier ones is bounded: a rolling frame reaches back a fixed
number of rows, a return one known price, a horizon a number of months.  A state holds,
for each security, its last rows (as many as the longest frame), the last price known
before them and how many rows there were, and one row a month.  ``extend`` computes the
new days from these and the new rows alone and gives the state after them; states of
parts that follow each other add up to that of the whole.

A load may begin in the middle of a month: what the month had before it stands, and the
load fills in what was missing.  New rows must be of later days than those known of
the same security; others end the call with an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.operators.hot_series import CHUNK_ROWS, SPLIT_ROWS, TIE, split_hot_series
from factorloom.operators.series import SPLIT_COLUMNS, features_of_split, first_non_null
from factorloom.plans.factors import monthly_rows, panel_of_months, panel_rows, snapshot_columns
from factorloom.schema import DAYS_PER_MONTH, MOMENTUM_MONTHS, ROLLING_MONTHS, SERIES_KEYS
from factorloom.session import materialize


@dataclass(frozen=True)
class PanelState:
    """``tail``: the last rows of each security, with ``_position``; ``series``: ``carried`` and
    ``offset``, from before the tail; ``monthly``: a row a month and load, numbered by ``load``."""

    tail: DataFrame
    series: DataFrame
    monthly: DataFrame
    load: int
    order: tuple
    months: tuple
    days_per_month: int

    @property
    def halo_rows(self) -> int:
        return self.days_per_month * max(self.months) + 2

    def panel(self, back=MOMENTUM_MONTHS, forward: int = 12) -> DataFrame:
        """What ``price_panel`` gives for all rows so far."""
        load = F.col("load")
        whole = self.monthly.groupBy(*SERIES_KEYS, "month_no").agg(
            F.min("anchor_date").alias("anchor_date"), F.min_by("anchor_price", load).alias("anchor_price"),
            *[first_non_null(c, load).alias(c) for c in snapshot_columns(self.months)])
        return panel_of_months(whole, self.months, back, forward)


def begin(prices: DataFrame, order=("datadate",), months=ROLLING_MONTHS, days_per_month: int = DAYS_PER_MONTH,
          split_rows: int | None = SPLIT_ROWS, chunk_rows: int = CHUNK_ROWS,
          sizes: DataFrame | None = None) -> PanelState:
    """The state after ``prices``, the only pass over history."""
    empty = PanelState(prices.limit(0), prices.limit(0), prices.limit(0), 0, order, tuple(months), days_per_month)
    split = split_hot_series(panel_rows(prices, order), halo_rows=empty.halo_rows, carry="adj_close_price",
                             order=order, split_rows=split_rows, chunk_rows=chunk_rows, sizes=sizes)
    return _after(empty, split, None)


def extend(state: PanelState, prices: DataFrame) -> PanelState:
    """The state after ``prices`` as well.  Only their rows and the state are read."""
    keys, day = list(SERIES_KEYS), state.order[0]
    new = materialize(panel_rows(prices, state.order), "new-days")
    last = state.tail.groupBy(*keys).agg(F.max(day).alias("_last"))
    if not new.join(last, keys).filter(F.col(day) <= F.col("_last")).isEmpty():
        raise ValueError(f"rows of days that are known already, or earlier ones, in {day}")
    if len(state.order) == 1:
        new = new.withColumn(TIE, F.xxhash64(*new.columns))
    rows = state.tail.drop("_position").withColumn("is_halo", F.lit(True)).unionByName(
        new.withColumn("is_halo", F.lit(False)))
    split = rows.join(state.series, keys, "left").withColumns(
        {"chunk": F.lit(0).cast("long"), "offset": F.coalesce("offset", F.lit(0).cast("long"))})
    return _after(state, split, state)


def _after(shape: PanelState, split: DataFrame, earlier: PanelState | None) -> PanelState:
    keys, day = list(SERIES_KEYS), shape.order[0]
    daily = materialize(features_of_split(split, shape.order, shape.months, shape.days_per_month)
                        .filter(F.lit(True) if earlier else ~F.col("is_halo")), "daily-features")
    fresh = daily.filter(~F.col("is_halo"))
    monthly = monthly_rows(fresh, day, shape.months).withColumn("load", F.lit(shape.load))
    if earlier:
        monthly = earlier.monthly.unionByName(monthly)
    held = [c for c in split.columns if c not in SPLIT_COLUMNS or c == TIE]
    ends = materialize(daily.groupBy(*keys).agg(F.max("_position").alias("_n")), "series-ends")
    known = daily.join(ends, keys)
    in_tail = F.col("_position") > F.col("_n") - shape.halo_rows
    tail = known.filter(in_tail).select(*held, "_position")
    price, place = F.col("adj_close_price"), F.col("_position")
    known_before = F.max_by(price, F.when(~in_tail & price.isNotNull(), place))
    if earlier:  # securities without new rows are here, too, as their tail is
        known_before = F.coalesce(known_before, F.max("carried"))
    before = known.groupBy(*keys).agg(
        known_before.cast("double").alias("carried"),
        F.greatest(F.max("_n") - shape.halo_rows, F.lit(0)).cast("long").alias("offset"))
    return PanelState(materialize(tail, "panel-tail"), materialize(before, "panel-series"),
                      materialize(monthly, "panel-months"), shape.load + 1, shape.order, shape.months,
                      shape.days_per_month)
