"""Column layouts, fixed values and the missing-value rule.

Missing data is SQL NULL everywhere.  NaN is turned into NULL when a table is
loaded, and every division yields NULL for a zero denominator, so that one
undefined ratio never poisons the mean or deviation of its whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(),
             "t": T.DateType(), "l": T.LongType()}
    fields = [item.split(":") for item in spec.split()]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


# Daily source rows as delivered by the data vendor.
RAW_PRICE = _struct(
    "isin:s datadate:t conm:s exchg:s prcod:d prchd:d prcld:d prccd:d cshtrd:d "
    "ajexdi:d cshoc:d div:d prcstd:s tpci:s gind:s gsubind:s")

# Annual statement rows as delivered by the data vendor.
RAW_STATEMENT = _struct(
    "isin:s exchg:s fyear:i datadate:t at:d revt:d oiadp:d ebitda:d oancf:d "
    "popsrc:s datafmt:s consol:s")

PRICE = _struct(
    "isin:s datadate:t conm:s exchg:s open_price:d high_price:d low_price:d "
    "close_price:d trading_volume:d adj_open_price:d adj_high_price:d "
    "adj_low_price:d adj_close_price:d adj_trading_volume:d "
    "num_of_listed_stocks:d market_capitalization:d dividend_per_share:d "
    "trs_flag:i stock_gb:s gic_industry:s gic_sub_industry:s")

STATEMENT = _struct(
    "isin:s exchg:s fyear:i datadate:t assets:d revenue:d operating_income:d "
    "earnings_before_interest:d cash_flow:d")

EXCHANGE = _struct("exchg:s exchange_name:s country:s label:s")

SERIES_KEYS = ("exchg", "isin")
PANEL_KEYS = ("exchg", "isin", "year")

# Names of the predictors and of the target.
QUALITY = ("assets", "revenue", "operating_income",
           "earnings_before_interest", "cash_flow")
VALUE = ("pbr", "psr", "por", "per", "pcr")
TARGET = "return_1y_later"

# Horizons in months.
ROLLING_MONTHS = (1, 3, 6, 12, 24, 36)
MOMENTUM_MONTHS = (1, 6, 12, 24, 36)
DAYS_PER_MONTH = 21

# Cut points of the 17-year average purchasing power parity.
PPP_CUTS = (3975.735294, 10340.588235, 22743.235294)
PPP_GROUPS = ("Low Development", "Middle Low Development",
              "Middle High Development", "High Development")
PPP_YEARS = tuple(range(2005, 2022))

# Lower bounds of the development index levels.
HDI_CUTS = (0.55, 0.7, 0.8)
HDI_LEVELS = ("LOW", "MEDIUM", "HIGH", "VERY HIGH")

# Exchange code, exchange, country, development label.
EXCHANGES = (
    ("308", "Chittagong", "Bangladesh", "Developing Country"),
    ("314", "Dacca", "Bangladesh", "Developing Country"),
    ("309", "Abidjan", "Cote dIvoire", "Developing Country"),
    ("214", "Nairobi", "Kenya", "Developing Country"),
    ("197", "Lusaka", "Zambia", "Developing Country"),
    ("166", "Harare", "Zimbabwe", "Developing Country"),
    ("106", "Australian Stock Exchange", "Australia", "Developed Country"),
    ("221", "Nicosia", "Cyprus", "Developed Country"),
    ("201", "Madrid", "Spain", "Developed Country"),
    ("209", "Milan", "Italy", "Developed Country"),
    ("251", "Singapore", "Singapore", "Developed Country"),
)

# Codes of countries whose index-table name differs from the
# name used by the country metadata.
HDI_CODE_OVERRIDES = (
    ("Hong Kong, China (SAR)", "HKG"),
    ("Korea (Republic of)", "KOR"),
    ("Czechia", "CZE"),
    ("Slovakia", "SVK"),
    ("Bahamas", "BHS"),
    ("Saint Kitts and Nevis", "KNA"),
    ("Iran (Islamic Republic of)", "IRN"),
    ("Moldova (Republic of)", "MDA"),
    ("Saint Vincent and the Grenadines", "VCT"),
    ("Egypt", "EGY"),
    ("Palestine, State of", "PSE"),
    ("Saint Lucia", "LCA"),
    ("Viet Nam", "VNM"),
    ("Bolivia (Plurinational State of)", "BOL"),
    ("Kyrgyzstan", "KGZ"),
    ("Venezuela (Bolivarian Republic of)", "VEN"),
    ("Micronesia (Federated States of)", "FSM"),
    ("Sao Tome and Principe", "STP"),
    ("Lao People's Democratic Republic", "LAO"),
    ("Eswatini (Kingdom of)", "SWZ"),
    ("Congo", "COG"),
    ("Tanzania (United Republic of)", "TZA"),
    ("Gambia", "GMB"),
    ("Congo (Democratic Republic of the)", "COD"),
    ("Yemen", "YEM"),
)


def volatility_columns(months=ROLLING_MONTHS) -> list[str]:
    return [f"daily_vol_{m}m" for m in months]


def liquidity_columns(months=ROLLING_MONTHS) -> list[str]:
    return [f"avg_transaction_amount_{m}m" for m in months]


def momentum_columns(months=MOMENTUM_MONTHS) -> list[str]:
    return [f"momentum_{m}m" for m in months]


def growth_columns() -> list[str]:
    return [f"{c}_yoy" for c in QUALITY]


def factor_columns(rolling=ROLLING_MONTHS, momentum=MOMENTUM_MONTHS) -> list[str]:
    """The predictors of the merged annual panel, in its column order."""
    return (["market_capitalization", *QUALITY, *VALUE, "dividend_per_share"]
            + volatility_columns(rolling) + liquidity_columns(rolling)
            + growth_columns() + momentum_columns(momentum))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column."""
    floating = {f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select([
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c)
        for c in df.columns])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to ``schema``; columns that are absent raise an error."""
    absent = [f.name for f in schema.fields if f.name not in df.columns]
    if absent:
        raise ValueError(f"columns missing from the source: {absent}")
    return nan_to_null(df.select([F.col(f.name).cast(f.dataType) for f in schema.fields]))
