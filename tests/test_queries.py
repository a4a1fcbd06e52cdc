"""Every query against its SQL counterpart."""

import pytest

import __spark_entry__ as driver
from checks import oracles, queries
from checks.compare import connect, differences
from tests.conftest import SMALL, TINY

# The regression needs more rows than predictors, which the tiny tables lack.
REGRESSION = {"ols_grouped", "gram_sums", "significant_factors", "sig_count_by_label",
              "sig_avg_by_label", "fill_missing_groups", "beta_matrix", "analyze_one_country",
              "analyze_all_countries", "null_ratio_columns", "ols_grouped_dropped",
              "analyze_dual_listed", "quartiles_by_exchange_year", "spearman_by_country"}


@pytest.fixture(scope="module")
def databases():
    return {folder: connect(folder) for folder in (TINY, SMALL)}


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_matches_sql(spark, databases, name):
    folder = SMALL if name in REGRESSION else TINY
    rows, bad, example = differences(driver.queries()[name](spark, folder), databases[folder],
                                     driver.oracle_sql()[name])
    assert bad == 0, example
    assert rows > 0


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(queries.QUERIES) == set(oracles.ORACLES)


def test_sample_has_the_asked_number_of_distinct_customers(spark):
    rows = driver.queries()["sample_n"](spark, TINY).collect()
    assert len(rows) == len({r.c_custkey for r in rows}) == 10


def test_entry(spark):
    assert driver.entry(spark).count() == 27
