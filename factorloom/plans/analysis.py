"""From daily prices and statements to coefficients per country.

All countries run in one job; the country is a group key, not a loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.operators.crosssec import (cross_section_stats, kept_factors,
                                           normalize_cross_section, score_null_ratios)
from factorloom.operators.regression import fit_grouped, masked_design
from factorloom.plans.factors import factor_panel
from factorloom.schema import (MOMENTUM_MONTHS, ROLLING_MONTHS, TARGET, factor_columns)
from factorloom.session import materialize
from factorloom.sources.market import STATEMENT_FILTER, in_country, scan_statements

NULL_LIMIT = 0.2


@dataclass(frozen=True)
class Design:
    """The regression input: complete scored rows, and the factors each country keeps."""

    rows: DataFrame
    factors: list[str]
    scored: DataFrame
    kept: DataFrame


def scoped_statements(statements: DataFrame, chosen: DataFrame) -> DataFrame:
    """Statements of the chosen exchanges, one of each (country, security, fiscal year)."""
    if set(STATEMENT_FILTER) <= set(statements.columns):  # not scanned yet
        return scan_statements(statements, exchanges=chosen)
    return in_country(statements, chosen)


def regression_design(prices: DataFrame, statements: DataFrame, exchanges: DataFrame,
                      country: str | None = None, null_limit: float = NULL_LIMIT,
                      **options) -> Design:
    """Panel, z-scores per (exchange, year), and complete cases per country.

    The annual panel is read twice (group summaries, fit), so it is written once:
    it is about 250 times smaller than the daily prices.  The summaries, one row
    per (exchange, year), are written too, which gives them a known size: the
    planner broadcasts them when small.  The factors a country keeps follow from
    the summaries, and are written for the same reason.

    ``statements`` may be the source's rows: they are scanned here, so that a security
    that is listed in several countries keeps a statement of each year in each.  Rows
    that are scanned already should be unique within a country.
    """
    factors = factor_columns(options.get("months", ROLLING_MONTHS),
                             options.get("back", MOMENTUM_MONTHS))
    chosen = exchanges.filter(F.col("country").isNotNull()).select("exchg", "country").distinct()
    if country is not None:
        chosen = chosen.filter(F.col("country") == country)
    panel = materialize(
        factor_panel(in_country(prices, chosen), scoped_statements(statements, chosen), **options)
        .join(chosen, "exchg"), "panel")
    columns = [*factors, TARGET]
    stats = materialize(cross_section_stats(panel, columns), "panel-stats")
    scored = normalize_cross_section(panel, columns, stats=stats)
    kept = materialize(kept_factors(score_null_ratios(stats.join(chosen, "exchg"), factors),
                                    ("country",), null_limit), "kept-factors")
    rows = masked_design(scored, factors, TARGET, "country", kept)
    return Design(rows, factors, scored, kept)


def analyze_countries(prices: DataFrame, statements: DataFrame, exchanges: DataFrame,
                      country: str | None = None, **options) -> DataFrame:
    """(country, factor, beta, pvalue, n_obs, df_resid, rank) for one or all countries."""
    design = regression_design(prices, statements, exchanges, country, **options)
    return fit_grouped(design.rows, design.factors, TARGET, "country")
