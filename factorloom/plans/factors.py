"""The eight factor families and their merge into an annual panel.

Each family is available alone.  ``price_panel`` computes all families that
come from daily prices in one pass over them; the pipelines use it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.scalars import month_number, ratio, reporting_year, simple_return
from factorloom.operators.hot_series import CHUNK_ROWS, SPLIT_ROWS
from factorloom.operators.series import (change_over_rows, daily_features, first_non_null,
                                         horizon_lookup, january_snapshot, month_anchor,
                                         rolling_liquidity, rolling_volatility)
from factorloom.schema import (DAYS_PER_MONTH, MOMENTUM_MONTHS, PANEL_KEYS, QUALITY,
                               ROLLING_MONTHS, TARGET, VALUE, factor_columns, growth_columns,
                               liquidity_columns, momentum_columns, volatility_columns)

# Which statement item each price ratio divides by.
VALUE_DENOMINATORS = {"pbr": "assets", "psr": "revenue", "por": "operating_income",
                      "per": "earnings_before_interest", "pcr": "cash_flow"}


def size(prices: DataFrame, order=("datadate",)) -> DataFrame:
    return january_snapshot(prices, ["market_capitalization"], order)


def dividend_yield(prices: DataFrame, order=("datadate",)) -> DataFrame:
    return january_snapshot(prices, ["dividend_per_share"], order)


def quality(statements: DataFrame) -> DataFrame:
    """Statement items, dated two years after the fiscal year (reporting lag)."""
    return statements.select("exchg", "isin", reporting_year("fyear").alias("year"),
                             "datadate", *QUALITY)


def _price_ratios() -> dict:
    return {name: ratio("market_capitalization", item)
            for name, item in VALUE_DENOMINATORS.items()}


def value(quality_rows: DataFrame, size_rows: DataFrame) -> DataFrame:
    return (quality_rows.drop("datadate").join(size_rows, list(PANEL_KEYS))
            .withColumns(_price_ratios()).select(*PANEL_KEYS, "datadate", *VALUE))


def volatility(prices: DataFrame, order=("datadate",), months=ROLLING_MONTHS,
               days_per_month: int = DAYS_PER_MONTH, split_rows: int | None = SPLIT_ROWS,
               chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    needed = prices.select("exchg", "isin", *order, *_missing("adj_close_price", order))
    rolled = rolling_volatility(needed, order=order, months=months,
                                days_per_month=days_per_month, split_rows=split_rows,
                                chunk_rows=chunk_rows)
    return january_snapshot(rolled, volatility_columns(months), order)


def liquidity(prices: DataFrame, order=("datadate",), months=ROLLING_MONTHS,
              days_per_month: int = DAYS_PER_MONTH, split_rows: int | None = SPLIT_ROWS,
              chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    needed = prices.select("exchg", "isin", *order, *_missing("adj_close_price", order),
                           "adj_trading_volume")
    rolled = rolling_liquidity(needed, order=order, months=months,
                               days_per_month=days_per_month, split_rows=split_rows,
                               chunk_rows=chunk_rows)
    return january_snapshot(rolled, liquidity_columns(months), order)


def _missing(column: str, order) -> list[str]:
    return [] if column in order else [column]


def growth(quality_rows: DataFrame, require_consecutive: bool = False) -> DataFrame:
    return change_over_rows(quality_rows, QUALITY, require_consecutive=require_consecutive) \
        .select(*PANEL_KEYS, "datadate", *growth_columns())


def _momentum_ratios(back, forward: int) -> dict:
    made = {f"momentum_{k}m": simple_return("anchor_price", f"bf_{k}m_price") for k in back}
    made[TARGET] = simple_return(f"aft_{forward}m_price", "anchor_price")
    return made


def momentum(prices: DataFrame, order=("datadate",), back=MOMENTUM_MONTHS,
             forward: int = 12) -> DataFrame:
    """Returns over the past horizons and over the year ahead (the target)."""
    found = horizon_lookup(month_anchor(prices, order=order), back, (forward,))
    return found.withColumns(_momentum_ratios(back, forward)).select(
        "exchg", "isin", F.floor(F.col("month_no") / 12).cast("int").alias("year"),
        F.col("anchor_date").alias("datadate"), *momentum_columns(back), TARGET)


def merge_families(frames) -> DataFrame:
    """Inner merge of factor families on (exchange, security, year)."""
    plain = [f.drop("datadate") for f in frames]
    return reduce(lambda a, b: a.join(b, list(PANEL_KEYS)), plain)


def price_panel(prices: DataFrame, order=("datadate",), months=ROLLING_MONTHS,
                back=MOMENTUM_MONTHS, forward: int = 12,
                days_per_month: int = DAYS_PER_MONTH, split_rows: int | None = SPLIT_ROWS,
                chunk_rows: int = CHUNK_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """Size, yield, volatility, liquidity, momentum and target in one pass.

    Daily rows are shuffled once, by security, and not at all when they come from a
    ``DailyStore``, whose ``series`` are the ``sizes`` to pass.  They are then combined per
    security and month: each month yields its anchor, and each January also the
    first non-null value of every snapshot column.  The horizons are looked up
    among these monthly rows.  The result equals the inner merge of the five
    families, because all of them have a row for the same Januaries.
    """
    day = order[0]
    daily = daily_features(panel_rows(prices, order), order=order, months=months,
                           days_per_month=days_per_month, split_rows=split_rows,
                           chunk_rows=chunk_rows, sizes=sizes)
    return panel_of_months(monthly_rows(daily, day, months), months, back, forward)


def panel_rows(prices: DataFrame, order) -> DataFrame:
    """The rows and columns of daily prices that a panel needs."""
    needed = dict.fromkeys(["exchg", "isin", *order, "adj_close_price", "adj_trading_volume",
                            "market_capitalization", "dividend_per_share"])
    return prices.filter(F.col("exchg").isNotNull() & F.col("isin").isNotNull()).select(*needed)


def snapshot_columns(months=ROLLING_MONTHS) -> list[str]:
    return ["market_capitalization", "dividend_per_share", *volatility_columns(months),
            *liquidity_columns(months)]


def monthly_rows(daily: DataFrame, day: str = "datadate", months=ROLLING_MONTHS) -> DataFrame:
    """One row per month of a security: its anchor and, in January, the first known value of
    every snapshot column.  Only Januaries and the first row of each month are used."""
    january = F.month(day) == 1
    return (daily.filter(january | F.col("_opens_month"))
            .groupBy("exchg", "isin", month_number(day).alias("month_no"))
            .agg(F.min(day).alias("anchor_date"),
                 F.min_by("adj_close_price", "_position").alias("anchor_price"),
                 *[first_non_null(c, F.col("_position"), january).alias(c)
                   for c in snapshot_columns(months)]))


def panel_of_months(monthly: DataFrame, months=ROLLING_MONTHS, back=MOMENTUM_MONTHS,
                    forward: int = 12) -> DataFrame:
    """The panel's rows from monthly ones: horizons are looked up among them."""
    found = horizon_lookup(monthly, back, (forward,))
    return found.withColumns(_momentum_ratios(back, forward)).select(
        "exchg", "isin", F.floor(F.col("month_no") / 12).cast("int").alias("year"),
        *snapshot_columns(months), *momentum_columns(back), TARGET)


def statement_panel(statements: DataFrame) -> DataFrame:
    """Quality and growth of each statement in one pass."""
    return change_over_rows(quality(statements), QUALITY) \
        .select(*PANEL_KEYS, *QUALITY, *growth_columns())


def with_statements(price_rows: DataFrame, statements: DataFrame, months=ROLLING_MONTHS,
                    back=MOMENTUM_MONTHS) -> DataFrame:
    """A price panel with what statements add to it."""
    merged = price_rows.join(statement_panel(statements), list(PANEL_KEYS))
    names = factor_columns(months, back)
    return merged.withColumns(_price_ratios()).select(*PANEL_KEYS, *names, TARGET)


def factor_panel(prices: DataFrame, statements: DataFrame, **options) -> DataFrame:
    """All predictors and the target, one row per (exchange, security, year)."""
    return with_statements(price_panel(prices, **options), statements,
                           options.get("months", ROLLING_MONTHS), options.get("back", MOMENTUM_MONTHS))
