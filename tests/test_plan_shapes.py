"""The physical plans have the shape they were designed for."""

import re

from checks import queries
from factorloom.operators import series
from factorloom.plans import factors
from factorloom.sources import market
from factorloom.sources import sample_tables as st
from tests.conftest import TINY


def prices(spark):
    return market.scan_prices(st.raw_prices(spark, TINY), keep=st.TIES)


def test_momentum_needs_two_shuffles_one_window_and_no_self_join(spark, plan_text):
    text = plan_text(factors.momentum(prices(spark), st.PRICE_ORDER))
    assert text.count("Exchange hashpartitioning") == 2
    assert len(re.findall(r"(?<![a-z])Window \[", text)) == 1
    assert "SortMergeJoin" not in text


def test_rolling_statistics_share_one_shuffle_and_one_sort(spark, plan_text):
    text = plan_text(series.daily_features(prices(spark), order=st.PRICE_ORDER, split_rows=None))
    assert text.count("Exchange hashpartitioning") == 1
    assert len(re.findall(r"(?<![a-zA-Z])Sort \[", text)) == 1


def test_panel_shuffles_daily_rows_once(spark, plan_text):
    text = plan_text(factors.price_panel(prices(spark), order=st.PRICE_ORDER, split_rows=None))
    # Series known to be short: the monthly steps reuse the partitioning by security.
    assert text.count("Exchange hashpartitioning") == 1
    assert "Join" not in re.sub("BroadcastHashJoin", "", text)


def test_filters_and_columns_reach_the_scan(spark, plan_text, tmp_path):
    st.raw_prices(spark, TINY).write.parquet(str(tmp_path / "prices"))
    st.raw_statements(spark, TINY).write.parquet(str(tmp_path / "statements"))
    raw = spark.read.parquet(str(tmp_path / "prices"))
    text = plan_text(factors.size(market.scan_prices(raw, "1996-01-01", "1999-01-01")))
    assert "GreaterThan(datadate,1996-01-01)" in text and "LessThan(datadate,1999-01-01)" in text
    read = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"isin", "datadate", "exchg", "prccd",
                                                          "cshoc"}
    statements = spark.read.parquet(str(tmp_path / "statements"))
    text = plan_text(market.scan_statements(statements, "1996-01-01", "1999-01-01"))
    for pushed in ("EqualTo(popsrc,I)", "EqualTo(datafmt,HIST_STD)", "EqualTo(consol,C)",
                   "LessThanOrEqual(datadate,1999-01-01)"):
        assert pushed in text


def test_python_runs_only_in_the_fit(spark, plan_text):
    python = ("MapInPandas", "FlatMapGroupsInPandas", "ArrowEvalPython", "BatchEvalPython")
    for name in ("factor_panel_one_pass", "normalize_cross_section", "spearman_rank",
                 "development_groups", "hdi_groups", "null_ratio_columns"):
        text = plan_text(queries.QUERIES[name](spark, TINY))
        assert not any(p in text for p in python), name


def test_no_cross_joins(spark, plan_text):
    for name in ("factor_panel_one_pass", "fit_line_points", "crosstab_groups", "spearman_rank",
                 "price_semi_country", "label_countries", "rejoin_after_repair"):
        text = plan_text(queries.QUERIES[name](spark, TINY))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_one_row_a_day_is_combined_by_hash(spark, plan_text):
    """With the date as the only order, the first of a month needs no sort."""
    text = plan_text(factors.momentum(prices(spark)))
    assert "HashAggregate" in text and "SortAggregate" not in text
    assert "SortAggregate" not in plan_text(factors.size(prices(spark)))


def test_fit_moves_factors_not_rows(spark, plan_text):
    """The panel goes from its scan to the first Python step without a shuffle."""
    from factorloom.operators import regression
    from factorloom.plans import analysis
    from factorloom.schema import TARGET
    design = analysis.regression_design(prices(spark), market.scan_statements(
        st.raw_statements(spark, TINY)), st.exchanges(spark, TINY), order=st.PRICE_ORDER,
        days_per_month=7)
    text = plan_text(regression.partial_factors(design.rows, [*design.factors, TARGET], "country"))
    panel_branch = text[text.index("MapInPandas"):]
    probe = panel_branch[:panel_branch.index("FileScan")]
    assert "Exchange hashpartitioning" not in probe and "SortMergeJoin" not in probe
