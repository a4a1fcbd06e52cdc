"""The sample star schema in the roles of the market and country sources.

``FIXTURES.md`` part B describes the mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.scalars import ratio
from factorloom.operators.packed_order import Field, PackedOrder, date_field
from factorloom.sources.market import exchange_table

# Several rows of a security share a date; this order makes them a series.
PRICE_ORDER = PackedOrder(date_field("datadate"), Field("k_order", 33), Field("k_line", 6), Field("k_part", 27),
                          Field("close_price", 36, per_unit=100))
TIES = ("k_order", "k_line", "k_part")
PPP_SAMPLE_YEARS = tuple(range(1995, 2002))


# Declared, so that planning a query needs no job to look at the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _with_listing(rows: DataFrame, spark, folder) -> DataFrame:
    """Add company name and exchange; tables are joined one by one so that the
    planner sees the file size of each."""
    return (rows.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .withColumns({"conm": F.col("s_name"),
                          "exchg": F.col("n_regionkey").cast("string")}))


def raw_prices(spark: SparkSession, folder: str, industry: bool = False) -> DataFrame:
    """lineitem as daily quotes.  The part table is joined only for the industry codes."""
    line = table(spark, folder, "lineitem")
    price, disc = F.col("l_extendedprice"), F.col("l_discount")
    quotes = _with_listing(line, spark, folder)
    codes = [F.lit(None).cast("string").alias("gind"), F.lit(None).cast("string").alias("gsubind")]
    if industry:
        quotes = quotes.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        codes = [F.col("p_type").alias("gind"), F.col("p_brand").alias("gsubind")]
    return quotes.select(
        F.col("l_suppkey").cast("string").alias("isin"),
        F.to_date("l_shipdate").alias("datadate"), "conm", "exchg",
        (price * (1.0 - disc / 2.0)).alias("prcod"),
        (price * (1.0 + F.col("l_tax"))).alias("prchd"),
        (price * (1.0 - disc)).alias("prcld"), price.alias("prccd"),
        F.col("l_quantity").alias("cshtrd"),
        F.col("l_linenumber").cast("double").alias("ajexdi"),
        (F.col("l_quantity") * 1000.0).alias("cshoc"), F.col("l_tax").alias("div"),
        F.when(F.col("l_returnflag") == "R", "10").otherwise("4").alias("prcstd"),
        F.col("l_linestatus").alias("tpci"), *codes,
        F.col("l_orderkey").alias("k_order"), F.col("l_linenumber").alias("k_line"),
        F.col("l_partkey").alias("k_part"))


def long_prices(raw: DataFrame) -> DataFrame:
    """Quotes of four suppliers as those of one security, whose series then exceeds the
    longest rolling frame of 757 rows."""
    security = F.floor(F.col("isin").cast("long") / 4)
    return raw.withColumns({"isin": security.cast("string"), "exchg": (security % 5).cast("string")})


def listed_twice(raw: DataFrame) -> DataFrame:
    """Statements, with every third security also on the next exchange, 40 days later."""
    again = raw.filter(F.col("isin").cast("long") % 3 == 0).withColumns({
        "exchg": ((F.col("exchg").cast("int") + 1) % 5).cast("string"),
        "datadate": F.date_add("datadate", 40)})
    return raw.unionByName(again)


def quoted_twice(raw: DataFrame) -> DataFrame:
    """Quotes, with every third security also on the next exchange."""
    again = raw.filter(F.col("isin").cast("long") % 3 == 0).withColumn(
        "exchg", ((F.col("exchg").cast("int") + 1) % 5).cast("string"))
    return raw.unionByName(again)


def raw_statements(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem summed per supplier, year and quarter as statements."""
    line = table(spark, folder, "lineitem")
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    day = F.to_date("l_shipdate")
    sums = (line.groupBy(
                "l_suppkey", F.year(day).alias("fyear"), F.quarter(day).alias("quarter"),
                F.when(F.col("l_linestatus") == "O", "I").otherwise("D").alias("popsrc"),
                F.when(F.col("l_returnflag") == "R", "SUMM_STD").otherwise("HIST_STD")
                .alias("datafmt"))
            .agg(F.max(day).alias("datadate"), F.sum(price).alias("at"),
                 F.sum(price * (1.0 - disc)).alias("revt"),
                 F.sum(price * (1.0 - disc) * (1.0 - tax)).alias("oiadp"),
                 F.sum(price * (1.0 - tax)).alias("ebitda"),
                 F.sum(F.col("l_quantity") * price / 100.0).alias("oancf")))
    return (_with_listing(sums, spark, folder)
            .select(F.col("l_suppkey").cast("string").alias("isin"), "exchg", "fyear", "datadate",
                    "at", "revt", "oiadp", "ebitda", "oancf", "popsrc", "datafmt",
                    F.lit("C").alias("consol")))


# The sample exchanges; one code is listed twice, as in the original.
EXCHANGE_ROWS = (
    ("0", "AFRICA", "Developing", "Developing Country"),
    ("1", "AMERICA", "Developed", "Developed Country"),
    ("2", "ASIA", "Developing", "Developing Country"),
    ("2", "ASIA", "Developing", "Developing Country"),
    ("3", "EUROPE", "Developed", "Developed Country"),
    ("4", "MIDDLE EAST", "Developing", "Developing Country"),
)


def exchanges(spark: SparkSession, folder: str) -> DataFrame:
    """The regions as exchanges; each country has several.  ``folder`` is not read."""
    return exchange_table(spark, EXCHANGE_ROWS)


def ppp(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly order totals per customer, one column per year."""
    orders = table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    customer = table(spark, folder, "customer")
    wide = (orders.groupBy("o_custkey").pivot("year", list(PPP_SAMPLE_YEARS))
            .agg(F.sum("o_totalprice")))
    return (wide.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("c_custkey").cast("string").alias("country_code"),
                    F.col("c_name").alias("country_name"),
                    *[F.col(str(y)) for y in PPP_SAMPLE_YEARS]))


def ppp_metadata(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation, region = (table(spark, folder, n) for n in ("customer", "nation", "region"))
    return (customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("c_custkey").cast("string").alias("country_code"),
                    F.col("r_name").alias("region"), F.col("c_mktsegment").alias("income_group")))


def development_index(spark: SparkSession, folder: str) -> DataFrame:
    """customer as the index table: an index in 0..1 and an income measure."""
    orders = (table(spark, folder, "orders").groupBy("o_custkey")
              .agg(F.sum("o_totalprice").alias("gni_per_capita")))
    return (table(spark, folder, "customer")
            .join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select("c_custkey", F.col("c_name").alias("country"),
                    ratio(F.col("c_acctbal") + 1000.0, F.lit(11000.0)).alias("hdi"),
                    "c_acctbal", "gni_per_capita"))


def country_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """customer as the country metadata; names of one region are spelt differently."""
    customer, nation, region = (table(spark, folder, n) for n in ("customer", "nation", "region"))
    name = F.when(F.col("r_name") == "ASIA", F.concat(F.col("c_name"), F.lit(", Rep.")))
    return (customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("country_code"),
                    F.coalesce(name, F.col("c_name")).alias("table_name"),
                    F.col("r_name").alias("region"),
                    F.col("c_mktsegment").alias("income_group")))


def code_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Codes for the differently spelt names, except those of one nation (they stay open)."""
    customer, nation, region = (table(spark, folder, n) for n in ("customer", "nation", "region"))
    return (customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .filter((F.col("r_name") == "ASIA") & (F.col("n_name") != "NATION_2"))
            .select(F.col("c_name").alias("country"),
                    F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
                    .alias("override_code")))
