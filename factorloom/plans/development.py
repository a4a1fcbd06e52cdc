"""Development groups of countries, from purchasing power or from an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.scalars import bucket
from factorloom.operators.crosssec import complete_rows, row_mean
from factorloom.operators.ranks import add_rank, quantile_cuts
from factorloom.operators.reconcile import left_lookup, rejoin_after_repair, repair_keys
from factorloom.schema import HDI_CUTS, HDI_LEVELS, PPP_CUTS, PPP_GROUPS, PPP_YEARS
from factorloom.session import materialize


def average_ppp(ppp: DataFrame, years=PPP_YEARS) -> DataFrame:
    return ppp.withColumn("average_ppp", row_mean([str(y) for y in years]))


def complete_ppp(ppp: DataFrame, metadata: DataFrame, years=PPP_YEARS) -> DataFrame:
    """Countries with every year, a region and an income group.

    A full outer join followed by the removal of incomplete rows; the optimizer
    sees from the not-null terms that an inner join is enough.
    """
    joined = average_ppp(ppp, years).join(
        metadata.select("country_code", "region", "income_group"), "country_code", "full")
    return complete_rows(joined)


def development_groups(ppp: DataFrame, metadata: DataFrame, years=PPP_YEARS,
                       cuts=PPP_CUTS, labels=PPP_GROUPS) -> DataFrame:
    """Average purchasing power and group.  ``cuts=None`` takes the quartiles of the data."""
    complete = complete_ppp(ppp, metadata, years)
    if cuts is None:
        complete = materialize(complete, "complete-ppp")
        cuts = quantile_cuts(complete, "average_ppp")
    return complete.withColumn("development_group", bucket("average_ppp", cuts, labels))


def index_levels(table: DataFrame, value: str = "hdi", cuts=HDI_CUTS, labels=HDI_LEVELS):
    """Add ``hdi_group``; a missing index falls into the lowest level."""
    return table.withColumn("hdi_group", bucket(value, cuts, labels, missing=labels[0]))


def rank_difference(table: DataFrame, income: str = "gni_per_capita", index: str = "hdi",
                    ranges: int | None = None) -> DataFrame:
    """Add the index rank, and the income rank minus the index rank (1 = highest)."""
    ranked = add_rank(table, index, "hdi_rank", "min", descending=True, ranges=ranges)
    ranked = add_rank(ranked, income, "_income_rank", "min", descending=True, ranges=ranges)
    return ranked.withColumn("gni_rank_minus_hdi_rank",
                             F.col("_income_rank") - F.col("hdi_rank")).drop("_income_rank")


def hdi_groups(table: DataFrame, metadata: DataFrame, overrides: DataFrame) -> DataFrame:
    """Index levels with country codes, repaired where names differ, and region."""
    columns = ["region", "income_group"]
    coded = left_lookup(index_levels(table), metadata, "country", "table_name",
                        ["country_code", *columns])
    return rejoin_after_repair(repair_keys(coded, overrides, "country", "country_code"),
                               metadata, "country_code", columns)


def map_feed(groups: DataFrame, code: str, value: str, name: str) -> DataFrame:
    """(code, value, name) rows for a map."""
    return groups.select(F.col(code).alias("code"), F.col(value).alias("value"),
                         F.col(name).alias("name"))


def scatter_feed(groups: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """(group, x, y) rows for a scatter chart with one colour per group."""
    return groups.select(F.col(group).alias("group"), F.col(x).alias("x"), F.col(y).alias("y")) \
        .filter(F.col("group").isNotNull())
