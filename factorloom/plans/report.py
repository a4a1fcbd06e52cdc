"""Reports on fitted factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNIFICANCE = 0.10


def significant_factors(results: DataFrame, exchanges: DataFrame,
                        level: float = SIGNIFICANCE) -> DataFrame:
    """Factors with p <= level per country; a country without any keeps one empty row."""
    countries = exchanges.select("country", "label").distinct()
    passing = results.filter(F.col("pvalue") <= level).select("country", "factor", "beta", "pvalue")
    return countries.join(passing, "country", "left") \
        .select("country", "factor", "beta", "pvalue", "label")


def count_by_label(significant: DataFrame) -> DataFrame:
    return (significant.filter(F.col("factor").isNotNull()).groupBy("label")
            .agg(F.count(F.lit(1)).alias("significant")))


def average_by_label(significant: DataFrame) -> DataFrame:
    """Significant factors per country of a label, countries with none included."""
    return (significant.groupBy("label")
            .agg(F.count("factor").alias("significant"),
                 F.count_distinct("country").alias("countries"))
            .withColumn("per_country", F.col("significant") / F.col("countries")))


def fill_missing_groups(significant: DataFrame, factor: str = "market_capitalization",
                        beta: float = 0.0) -> DataFrame:
    """Give countries without a significant factor a neutral row for display."""
    empty = F.col("factor").isNull()
    return significant.withColumns({
        "beta": F.when(empty, F.lit(beta)).otherwise(F.col("beta")),
        "factor": F.when(empty, F.lit(factor)).otherwise(F.col("factor"))})


def beta_matrix(significant: DataFrame, countries) -> DataFrame:
    """Factors by country, one column per name in ``countries``."""
    return (fill_missing_groups(significant).groupBy("label", "factor")
            .pivot("country", list(countries)).agg(F.first("beta")))
