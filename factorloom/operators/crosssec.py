"""Operators across the securities of one exchange and year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.scalars import ratio


def cross_section_stats(panel: DataFrame, columns, keys=("exchg", "year")) -> DataFrame:
    """Rows, and mean, sample deviation and count of values per column, of each group."""
    return (panel.filter(_all_present(keys)).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.avg(c).alias(f"_mean_{c}") for c in columns],
                 *[F.stddev_samp(c).alias(f"_std_{c}") for c in columns],
                 *[F.count(c).alias(f"_held_{c}") for c in columns]))


def normalize_cross_section(panel: DataFrame, columns, keys=("exchg", "year"),
                            ids=("exchg", "isin", "year"),
                            stats: DataFrame | None = None) -> DataFrame:
    """``(x - mean) / deviation`` within each group, for every column.

    Groups are summarised and joined back rather than put in a window: a window
    would move each group whole into one task, and one exchange may hold a large
    share of all rows.  Pass materialized ``stats`` (one row per exchange and
    year) and the planner can see that they are small enough to broadcast;
    otherwise the join is a shuffle that adaptive execution splits when skewed.
    """
    stats = cross_section_stats(panel, columns, keys) if stats is None else stats
    scored = {c: ratio(F.col(c) - F.col(f"_mean_{c}"), f"_std_{c}") for c in columns}
    return (panel.join(stats, list(keys)).withColumns(scored)
            .select(*ids, *[c for c in panel.columns if c not in {*ids, *columns}], *columns))


def null_ratios(df: DataFrame, columns, by=()) -> DataFrame:
    """Long table (by..., factor, null_ratio): share of NULLs per column."""
    wide = df.groupBy(*by).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c)
                                 for c in columns])
    return wide.unpivot(list(by), list(columns), "factor", "null_ratio")


def score_null_ratios(stats: DataFrame, columns, by=("country",)) -> DataFrame:
    """The null ratios that the scores will have, from the group summaries alone.

    A score is missing where its value is, and in groups whose values do not
    vary.  This spares a pass over the panel.  ``stats`` must carry ``by``.
    """
    def missing(c):
        varies = F.coalesce(F.col(f"_std_{c}") != 0.0, F.lit(False))
        return F.when(varies, F.col("_rows") - F.col(f"_held_{c}")).otherwise(F.col("_rows"))
    wide = stats.groupBy(*by).agg(
        *[(F.sum(missing(c)) / F.sum("_rows")).alias(c) for c in columns])
    return wide.unpivot(list(by), list(columns), "factor", "null_ratio")


def kept_factors(ratios: DataFrame, by=("country",), limit: float = 0.2) -> DataFrame:
    """Per group, the factors whose share of NULLs is below ``limit``, as one array."""
    return (ratios.groupBy(*by).agg(F.sort_array(F.collect_list(
        F.when(F.col("null_ratio") < limit, F.col("factor")))).alias("kept")))


def _all_present(columns):
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns], F.lit(True))


def complete_rows(df: DataFrame, columns=None) -> DataFrame:
    """Rows without a NULL in ``columns`` (all columns by default).

    Written as ``isNotNull`` terms, which let the optimizer turn an outer join
    below into an inner one.
    """
    return df.filter(_all_present(df.columns if columns is None else columns))


def row_mean(columns):
    """Mean over the non-null values of several columns of one row."""
    values = F.filter(F.array(*[F.col(c) for c in columns]), lambda x: x.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return ratio(total, F.nullif(F.size(values), F.lit(0)).cast("double"))
