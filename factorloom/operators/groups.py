"""Summaries of grouped members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_members(df: DataFrame, column: str, group: str) -> DataFrame:
    return df.filter(F.col(column) == group)


def ordinal(column: str, ordered_labels):
    """Place of a label in a stated order; labels outside it are NULL."""
    places = F.create_map(*[F.lit(x) for i, l in enumerate(ordered_labels) for x in (l, i)])
    return F.try_element_at(places, F.col(column))


def crosstab(df: DataFrame, group: str, other: str, ordered_groups) -> DataFrame:
    """Members per pair of labels, with the sort place of the first label."""
    return (df.groupBy(group, other).agg(F.count(F.lit(1)).alias("members"))
            .withColumn("group_order", ordinal(group, ordered_groups)))


def crosstab_wide(df: DataFrame, group: str, other: str, others) -> DataFrame:
    return df.groupBy(group).pivot(other, list(others)).agg(F.count(F.lit(1)))


def boundary_members(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """The member with the lowest value of each group; equal values go by name."""
    lowest = F.min(F.struct(F.col(value), F.col(name))).alias("s")
    return (df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group)
            .agg(lowest, F.count(F.lit(1)).alias("members"))
            .select(group, F.col(f"s.{name}").alias(name), F.col(f"s.{value}").alias(value),
                    "members"))


def mean_abs(df: DataFrame, group: str, value: str, strict: bool = False) -> DataFrame:
    """Mean of absolute values; ``strict`` makes a group with a NULL undefined."""
    mean = F.avg(F.abs(F.col(value)))
    if strict:
        mean = F.when(F.count(value) == F.count(F.lit(1)), mean)
    return df.groupBy(group).agg(mean.alias("mean_abs"), F.count(value).alias("members"))


def distinct_labels(df: DataFrame, *columns) -> DataFrame:
    return df.select(*columns).distinct()


def ranked(df: DataFrame, value: str, *ties) -> DataFrame:
    """Rows in ascending order of ``value`` (a range-partitioned sort)."""
    return df.orderBy(value, *ties)
