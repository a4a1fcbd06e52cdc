"""Scans of the daily price and annual statement sources.

The sources are DataFrames (Parquet, JDBC, ...); filters and column lists are
left to the optimizer to push into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.scalars import (capitalization, split_adjusted_price,
                                          split_adjusted_volume)
from factorloom.operators.hot_series import order_key
from factorloom.schema import EXCHANGE, EXCHANGES, nan_to_null

# Price status code of a traded day, and the statement filters.
TRADED_STATUS = "10"
STATEMENT_FILTER = {"popsrc": "I", "datafmt": "HIST_STD", "consol": "C"}


def exchange_table(spark: SparkSession, rows=EXCHANGES) -> DataFrame:
    """Exchange → country and label; a code listed twice is kept once, as first listed.

    An inline table, whose size the planner knows: it broadcasts it, so that daily
    rows are not shuffled by exchange.
    """
    unique = {row[0]: row for row in reversed(list(rows))}
    names = ", ".join(f.name for f in EXCHANGE.fields)
    values = ", ".join(f"({', '.join(map(_literal, row))})" for row in unique.values())
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def _literal(value: str | None) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_country(df: DataFrame, exchanges: DataFrame, country: str | None = None) -> DataFrame:
    """Rows whose exchange is mapped (to ``country``, when given)."""
    if country is not None:
        exchanges = exchanges.filter(F.col("country") == country)
    return df.join(exchanges.select("exchg"), "exchg", "left_semi").select(*df.columns)


def scan_prices(raw: DataFrame, start: str | None = None, end: str | None = None,
                keep=()) -> DataFrame:
    """Daily prices strictly between ``start`` and ``end``, split-adjusted.

    ``keep`` names further source columns to carry (tie-breakers of the order).
    """
    rows = nan_to_null(raw).filter(F.col("isin").isNotNull())
    if start is not None:
        rows = rows.filter(F.col("datadate") > F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("datadate") < F.lit(end).cast("date"))
    quotes = {"open": "prcod", "high": "prchd", "low": "prcld", "close": "prccd"}
    return rows.select(
        "isin", "datadate", "conm", "exchg",
        *[F.col(c).alias(f"{name}_price") for name, c in quotes.items()],
        F.col("cshtrd").alias("trading_volume"),
        *[split_adjusted_price(c, "ajexdi").alias(f"adj_{name}_price")
          for name, c in quotes.items()],
        split_adjusted_volume("cshtrd", "ajexdi").alias("adj_trading_volume"),
        F.col("cshoc").alias("num_of_listed_stocks"),
        capitalization("prccd", "cshoc").alias("market_capitalization"),
        F.col("div").alias("dividend_per_share"),
        F.when(F.col("prcstd") == TRADED_STATUS, 1).otherwise(0).alias("trs_flag"),
        F.col("tpci").alias("stock_gb"), F.col("gind").alias("gic_industry"),
        F.col("gsubind").alias("gic_sub_industry"), *keep)


def scan_statements(raw: DataFrame, start: str | None = None, end: str | None = None,
                    order=("datadate",), exchanges: DataFrame | None = None) -> DataFrame:
    """The earliest statement of each (country, security, fiscal year), from (start, end].

    ``exchanges`` maps exchanges to countries; statements of other exchanges go,
    and a security listed in two countries keeps a statement in each, as if each
    country were queried alone.  Without a map a security keeps one statement.
    ``min_by`` combines rows before the shuffle (sorted in each task), where a row
    number would first move all of them.
    """
    rows = nan_to_null(raw).filter(F.col("isin").isNotNull())
    if start is not None:
        rows = rows.filter(F.col("datadate") > F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("datadate") <= F.lit(end).cast("date"))
    for name, wanted in STATEMENT_FILTER.items():
        rows = rows.filter(F.col(name) == wanted)
    payload = F.struct("exchg", "datadate", F.col("at").alias("assets"),
                       F.col("revt").alias("revenue"),
                       F.col("oiadp").alias("operating_income"),
                       F.col("ebitda").alias("earnings_before_interest"),
                       F.col("oancf").alias("cash_flow"))
    rows = rows.select("isin", "fyear", payload.alias("s"),
                       order_key(rows, order, ["exchg", "at", "revt", "oiadp", "ebitda", "oancf"]).alias("_order"))
    scope = []
    if exchanges is not None:
        scope = ["_country"]
        mapped = (exchanges.filter(F.col("country").isNotNull())
                  .select("exchg", F.col("country").alias("_country")).distinct())
        rows = rows.withColumn("exchg", F.col("s.exchg")).join(mapped, "exchg")
    first = rows.groupBy(*scope, "isin", "fyear").agg(F.min_by("s", "_order").alias("s"))
    return first.select("isin", "s.exchg", "fyear", "s.datadate", "s.assets", "s.revenue",
                        "s.operating_income", "s.earnings_before_interest", "s.cash_flow")
