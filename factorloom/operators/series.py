"""Operators on daily and monthly series of one security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.scalars import month_number, ratio
from factorloom.operators.hot_series import (CHUNK_ROWS, SPLIT_ROWS, TIE, order_key,
                                             split_hot_series, window_order)
from factorloom.schema import DAYS_PER_MONTH, MOMENTUM_MONTHS, ROLLING_MONTHS, SERIES_KEYS


# --- snapshots and anchors ---------------------------------------------------

def first_non_null(value: Column | str, order: Column, where: Column | None = None) -> Column:
    """Aggregate: the first non-null value in ``order`` (rows with NULL order are skipped)."""
    value = F.col(value) if isinstance(value, str) else value
    usable = value.isNotNull() if where is None else value.isNotNull() & where
    return F.min_by(value, F.when(usable, order))


def january_snapshot(prices: DataFrame, values, order=("datadate",), month: int = 1) -> DataFrame:
    """One row per (exchange, security, year): first non-null January value per column.

    Columns are filled independently, so one output row may mix January days.
    Partial aggregation runs before the shuffle, whatever the size of a series.
    """
    key = order_key(prices, order, values)
    day = order[0]
    return (prices.filter(F.month(day) == month)
            .filter(F.col("exchg").isNotNull() & F.col("isin").isNotNull())
            .groupBy("exchg", "isin", F.year(day).alias("year"))
            .agg(F.min(day).alias("datadate"),
                 *[first_non_null(v, key).alias(v) for v in values]))


def month_anchor(prices: DataFrame, price: str = "adj_close_price",
                 order=("datadate",)) -> DataFrame:
    """First trading day of each month of a security, and the price of that row."""
    day = order[0]
    return (prices.filter(F.col("exchg").isNotNull() & F.col("isin").isNotNull())
            .groupBy("exchg", "isin", month_number(day).alias("month_no"))
            .agg(F.min(day).alias("anchor_date"),
                 F.min_by(price, order_key(prices, order, [price])).alias("anchor_price")))


def horizon_lookup(anchors: DataFrame, back=MOMENTUM_MONTHS, forward=(12,),
                   month: int = 1) -> DataFrame:
    """January anchors with the anchors exactly k months before and after.

    A RANGE frame on the month number that is k months away and one month wide
    holds the wanted row or nothing, so all horizons share one sort and no join
    is needed.  As with exact-match joins, a January that lacks one of the
    horizons is dropped.  Input is monthly, so a series has few rows.
    """
    series = Window.partitionBy(*SERIES_KEYS).orderBy("month_no")
    steps = [(f"bf_{k}m", -k) for k in back] + [(f"aft_{k}m", k) for k in forward]
    found = {}
    for name, offset in steps:
        frame = series.rangeBetween(offset, offset)
        found[name] = F.first("anchor_date").over(frame)
        found[f"{name}_price"] = F.first("anchor_price").over(frame)
    kept = F.col("month_no") % 12 == month - 1
    for name, _ in steps:
        kept = kept & F.col(name).isNotNull()
    return anchors.withColumns(found).filter(kept)


# --- day-to-day changes ------------------------------------------------------

SPLIT_COLUMNS = ("chunk", "is_halo", "carried", "offset", TIE)


def _series_window(*extra) -> Window:
    return Window.partitionBy(*SERIES_KEYS, "chunk").orderBy(*extra)


def _with_returns(split: DataFrame, price: str, order, also=None) -> DataFrame:
    """Add ``daily_return`` (and the window columns of ``also``).

    The forward-filled price of the row before is the last non-null price before
    this row, and a missing price today is filled with the same value.
    """
    before = _series_window(*order).rowsBetween(Window.unboundedPreceding, -1)
    previous = F.coalesce(F.last(price, ignorenulls=True).over(before), F.col("carried"))
    return (split.withColumns({"_previous": previous, **(also or {})})
            .withColumn("daily_return",
                        ratio(F.coalesce(F.col(price), F.col("_previous")), "_previous")
                        - F.lit(1.0))
            .drop("_previous"))


def daily_returns(prices: DataFrame, price: str = "adj_close_price", order=("datadate",),
                  split_rows: int | None = SPLIT_ROWS, chunk_rows: int = CHUNK_ROWS,
                  sizes: DataFrame | None = None) -> DataFrame:
    """Add ``daily_return``: change of the forward-filled price against the row before."""
    split = split_hot_series(prices, halo_rows=1, carry=price, order=order,
                             split_rows=split_rows, chunk_rows=chunk_rows, sizes=sizes)
    return (_with_returns(split, price, window_order(order)).filter(~F.col("is_halo"))
            .drop(*SPLIT_COLUMNS))


def change_over_rows(df: DataFrame, values, order=("year",), keys=SERIES_KEYS,
                     suffix: str = "_yoy", require_consecutive: bool = False) -> DataFrame:
    """Relative change against the previous row of the group, NULLs filled forward.

    Rows are compared in order even when a year is missing in between, unless
    ``require_consecutive`` asks for exactly one year.  Meant for annual input.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = df.withColumns({f"_f_{v}": F.last(v, ignorenulls=True).over(so_far) for v in values})
    lagged = {f"_p_{v}": F.lag(f"_f_{v}").over(window) for v in values}
    if require_consecutive:
        lagged["_gap"] = F.col(order[0]) - F.lag(order[0]).over(window)
    filled = filled.withColumns(lagged)
    change = {}
    for v in values:
        c = ratio(f"_f_{v}", f"_p_{v}") - F.lit(1.0)
        change[f"{v}{suffix}"] = F.when(F.col("_gap") == 1, c) if require_consecutive else c
    return (filled.withColumns(change)
            .drop(*[f"_f_{v}" for v in values], *[f"_p_{v}" for v in values], "_gap"))


# --- rolling frames ----------------------------------------------------------
#
# A frame of m months covers days_per_month * m + 1 rows, up to 757.  Evaluating
# such a sliding frame row by row costs one step per row *and* frame position.
# Instead a long frame is glued from shorter ones that are already known at
# earlier rows (126 rows = six times 21, 756 = six times 126), which costs a few
# lags per row.  Nothing is ever subtracted, so an outlier leaves no rounding
# error behind once it is out of the frame.

def frame_plan(lengths, fan: int = 6) -> list[list[tuple[int, list[tuple[int, int]]]]]:
    """Levels of frame lengths in rows, each with the (offset, length) pieces it is made of.

    It starts from single rows.  A level reaches up to ``fan`` times the longest
    frame known before it, and all its lengths share one window.
    """
    known, todo = [1], sorted(set(lengths) - {1})
    levels = [[(1, [(0, 1)])]] if 1 in lengths else []
    while todo:
        reach = known[-1] * fan
        now = [n for n in todo if n <= reach] or [reach]
        level = []
        for length in now:
            pieces, at = [], 0
            while at < length:
                piece = max(k for k in known if k <= length - at)
                pieces.append((at, piece))
                at += piece
            level.append((length, pieces))
        levels.append(level)
        known = sorted({*known, *now})
        todo = [n for n in todo if n > reach]
    return levels


def _earlier(seen: dict, column: str, rows: int, order, empty: str = "NULL") -> str:
    """Name of ``column`` as it was ``rows`` rows ago, noted in ``seen``."""
    if rows == 0:
        return column
    name = f"{column}_ago{rows}"
    seen[name] = (f"lag({column}, {rows}, {empty}) OVER (PARTITION BY "
                  f"{', '.join(SERIES_KEYS)}, chunk ORDER BY {', '.join(order)})")
    return name


def _deviation(value: str, result: str | None, rows: int, pieces, order):
    """Window expressions, then plain expressions, of a full-frame deviation.

    A frame is carried as its mean and its sum of squared distances from that
    mean, both NULL unless all of its values are present.
    """
    mean, dev, centre = f"_mean{rows}_{value}", f"_dev{rows}_{value}", f"_mid{rows}_{value}"
    seen, parts = {}, []
    for at, piece in pieces:
        if piece == 1:
            parts.append((1, _earlier(seen, value, at, order), "0D"))
        else:
            parts.append((piece, _earlier(seen, f"_mean{piece}_{value}", at, order),
                          _earlier(seen, f"_dev{piece}_{value}", at, order)))
    made = {mean: f"({' + '.join(f'{n} * {m}' for n, m, _ in parts)}) / {rows}D",
            dev: " + ".join(f"{d} + {n} * pow({m} - {mean}, 2)" for n, m, d in parts)}
    if result:
        # The oldest row completes the frame of rows + 1.
        last = _earlier(seen, value, rows, order)
        made[centre] = f"({mean} * {rows} + {last}) / {rows + 1}D"
        made[result] = (f"sqrt(({dev} + {rows} * pow({mean} - {centre}, 2)"
                        f" + pow({last} - {centre}, 2)) / {rows}D)")
    return seen, made


def _average(value: str, result: str | None, rows: int, pieces, order):
    """Window expressions, then plain expressions, of a partial-frame average."""
    total, held = f"_sum{rows}_{value}", f"_n{rows}_{value}"
    seen, totals, counts = {}, [], []
    for at, piece in pieces:
        if piece == 1:
            one = _earlier(seen, value, at, order)
            totals.append(f"coalesce({one}, 0D)")
            counts.append(f"CAST({one} IS NOT NULL AS INT)")
        else:
            totals.append(_earlier(seen, f"_sum{piece}_{value}", at, order, "0D"))
            counts.append(_earlier(seen, f"_n{piece}_{value}", at, order, "0"))
    made = {total: " + ".join(totals), held: " + ".join(counts)}
    if result:
        last = _earlier(seen, value, rows, order)
        made[result] = (f"try_divide({total} + coalesce({last}, 0D),"
                        f" CAST({held} + CAST({last} IS NOT NULL AS INT) AS DOUBLE))")
    return seen, made


def add_rolling(df: DataFrame, *, spans=None, means=None, order=("datadate",),
                months=ROLLING_MONTHS, days_per_month: int = DAYS_PER_MONTH) -> DataFrame:
    """Rolling statistics for all frame lengths, in one sort order and few windows.

    ``spans`` maps a column to the name of its full-frame deviation, ``means`` to
    the name of its partial-frame average.  ``df`` needs a ``chunk`` column.
    """
    spans, means = spans or {}, means or {}
    kept = list(df.columns)
    month_of = {days_per_month * m: m for m in months}
    for level in frame_plan(month_of):
        seen, made = {}, {}
        for rows, pieces in level:
            for kind, columns in ((_deviation, spans), (_average, means)):
                for value, prefix in columns.items():
                    result = f"{prefix}_{month_of[rows]}m" if rows in month_of else None
                    new_seen, new_made = kind(value, result, rows, pieces, order)
                    seen.update(new_seen)
                    made.update(new_made)
        for step in (seen, made):
            df = df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in step.items()])
    wanted = [f"{p}_{m}m" for p in [*spans.values(), *means.values()] for m in months]
    return df.select(*kept, *wanted)


def _rolling_split(prices, months, days_per_month, order, split_rows, chunk_rows, price, sizes):
    # One row more than the longest frame, because a return looks one row back.
    return split_hot_series(prices, halo_rows=days_per_month * max(months) + 2, carry=price,
                            order=order, split_rows=split_rows, chunk_rows=chunk_rows, sizes=sizes)


def rolling_volatility(prices: DataFrame, price: str = "adj_close_price", order=("datadate",),
                       months=ROLLING_MONTHS, days_per_month: int = DAYS_PER_MONTH,
                       split_rows: int | None = SPLIT_ROWS, chunk_rows: int = CHUNK_ROWS,
                       sizes: DataFrame | None = None) -> DataFrame:
    """Sample deviation of daily returns over full frames; NULL while a frame is incomplete."""
    split = _rolling_split(prices, months, days_per_month, order, split_rows, chunk_rows, price, sizes)
    order = window_order(order)
    rolled = add_rolling(_with_returns(split, price, order), order=order,
                         spans={"daily_return": "daily_vol"}, months=months,
                         days_per_month=days_per_month)
    return rolled.filter(~F.col("is_halo")).drop(*SPLIT_COLUMNS)


def rolling_liquidity(prices: DataFrame, price: str = "adj_close_price",
                      volume: str = "adj_trading_volume", order=("datadate",),
                      months=ROLLING_MONTHS, days_per_month: int = DAYS_PER_MONTH,
                      split_rows: int | None = SPLIT_ROWS, chunk_rows: int = CHUNK_ROWS,
                      sizes: DataFrame | None = None) -> DataFrame:
    """Average traded amount over frames that may be partial at the start of a series."""
    split = _rolling_split(prices, months, days_per_month, order, split_rows, chunk_rows, None, sizes)
    amounts = split.withColumn("transaction_amount", F.col(price) * F.col(volume))
    rolled = add_rolling(amounts, order=window_order(order),
                         means={"transaction_amount": "avg_transaction_amount"},
                         months=months, days_per_month=days_per_month)
    return rolled.filter(~F.col("is_halo")).drop(*SPLIT_COLUMNS)


def daily_features(prices: DataFrame, order=("datadate",), months=ROLLING_MONTHS,
                   days_per_month: int = DAYS_PER_MONTH, split_rows: int | None = SPLIT_ROWS,
                   chunk_rows: int = CHUNK_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """Volatility and liquidity in one pass.

    Adds ``_position``, the place of a row in its series from 1, and
    ``_opens_month``, which marks (at least) the first row of each month.
    """
    split = _rolling_split(prices, months, days_per_month, order, split_rows, chunk_rows,
                           "adj_close_price", sizes)
    return features_of_split(split, order, months, days_per_month).filter(~F.col("is_halo")).drop(*SPLIT_COLUMNS)


def features_of_split(split: DataFrame, order, months, days_per_month: int) -> DataFrame:
    """``daily_features`` of rows that have the columns of ``split_hot_series``, halo rows included."""
    order = window_order(order)
    window = _series_window(*order)
    month = month_number(order[0])
    position = F.col("offset") + F.row_number().over(window)
    opens = F.coalesce(F.lag(month).over(window) != month, F.lit(True))
    daily = (_with_returns(split, "adj_close_price", order,
                           {"_position": position, "_opens_month": opens})
             .withColumn("transaction_amount",
                         F.col("adj_close_price") * F.col("adj_trading_volume")))
    return add_rolling(daily, order=order, spans={"daily_return": "daily_vol"},
                       means={"transaction_amount": "avg_transaction_amount"},
                       months=months, days_per_month=days_per_month)


__all__ = ["first_non_null", "january_snapshot", "month_anchor", "horizon_lookup",
           "daily_returns", "change_over_rows", "frame_plan", "add_rolling",
           "rolling_volatility", "rolling_liquidity", "daily_features", "features_of_split"]
