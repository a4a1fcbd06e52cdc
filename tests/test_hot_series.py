"""A series cut into ranges gives the same result as the whole series."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorloom.operators import hot_series, series
from factorloom.plans import factors
from tests.test_series import PRICES, long_series, to_spark

ORDER = ("datadate", "adj_trading_volume")


@pytest.fixture(scope="module")
def prices(spark):
    rng = np.random.default_rng(11)
    hot = long_series(3000, 12, holes=.2, isin="HOT")
    # Several rows a day, a long gap without prices, and a busy day.
    hot["datadate"] = np.sort(rng.choice(pd.bdate_range("2000-01-03", periods=700).date, 3000))
    hot.loc[1000:1400, "adj_close_price"] = np.nan
    hot.loc[2000:2200, "datadate"] = hot.loc[2000, "datadate"]
    hot["adj_trading_volume"] = rng.permutation(3000) * 1.0
    cold = [long_series(300, s, isin=f"C{s}") for s in range(5)]
    return to_spark(spark, pd.concat([hot, *cold])).cache()


def same(a, b, key):
    a, b = (x.toPandas().sort_values(key).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, rtol=1e-11, atol=1e-12)


@pytest.mark.parametrize("chunk_rows", [40, 1000])
def test_split_results_equal_unsplit(prices, chunk_rows):
    cut = {"split_rows": 500, "chunk_rows": chunk_rows}
    key = ["isin", *ORDER]
    same(series.daily_returns(prices, order=ORDER, **cut),
         series.daily_returns(prices, order=ORDER, split_rows=None), key)
    options = {"order": ORDER, "months": (1, 3), "days_per_month": 7}
    for rolling in (series.rolling_volatility, series.rolling_liquidity):
        same(rolling(prices, **options, **cut), rolling(prices, **options, split_rows=None), key)


def test_short_chunks_share_a_range(spark, prices, monkeypatch):
    dealt, place = [], hot_series._placed
    monkeypatch.setattr(hot_series, "_placed", lambda *a: dealt.append(a[-1]) or place(*a))
    cut = {"halo_rows": 2, "order": ORDER, "split_rows": 500}
    for chunk_rows in (3, 1000):
        split = hot_series.split_hot_series(prices, chunk_rows=chunk_rows, **cut)
        assert split.filter("NOT is_halo").count() == prices.count()
        assert split.filter("NOT is_halo").agg(F.max("chunk")).first()[0] == 3000 // chunk_rows - 1
    assert dealt == [int(spark.conf.get("spark.sql.shuffle.partitions")), 3]
    assert hot_series._ranges(spark, 36_000_000, 150) == 360
    assert hot_series._ranges(spark, 36_000_000, hot_series.CHUNK_ROWS) == 8


def test_panel_is_the_same_for_a_split_series(prices):
    options = {"order": ORDER, "months": (1, 3, 6), "days_per_month": 7, "back": (1, 6)}
    whole = factors.price_panel(prices, **options, split_rows=None)
    for chunk_rows in (60, 1000):
        same(factors.price_panel(prices, **options, split_rows=500, chunk_rows=chunk_rows), whole,
             ["isin", "year"])


def test_a_january_day_divided_over_ranges_keeps_its_order(spark):
    days = list(pd.bdate_range("2000-12-01", periods=21).date[:30])
    days = [days[k * len(days) // 30] for k in range(30)] + [pd.Timestamp("2001-01-03").date()] * 300
    pdf = long_series(330, 3)
    pdf["datadate"] = days
    pdf["seq"] = np.arange(330)[::-1] * 1.0
    pdf["market_capitalization"] = np.arange(330) * 1.0
    later = pdf.iloc[[0]].assign(datadate=pd.Timestamp("2002-01-02").date(), adj_close_price=99.0)
    for order in (("datadate", "seq"), ("datadate",)):
        df = spark.createDataFrame(pd.concat([pdf, later]))
        options = {"order": order, "months": (1,), "days_per_month": 5, "back": (1,)}
        split = factors.price_panel(df, **options, split_rows=50, chunk_rows=100)
        whole = factors.price_panel(df, **options, split_rows=None)
        same(split, whole, ["isin", "year"])
        if len(order) == 2:
            assert split.first()["market_capitalization"] == 329.0


def test_ranges_are_bounded_and_cover_the_series_once(prices):
    split = hot_series.split_hot_series(prices, halo_rows=50, order=ORDER, carry="adj_close_price",
                                        split_rows=500, chunk_rows=200)
    assert split.filter("NOT is_halo").count() == prices.count()
    per_chunk = split.filter("isin = 'HOT' AND NOT is_halo").groupBy("chunk").count().toPandas()
    assert len(per_chunk) == 15 and set(per_chunk["count"]) == {200}
    halos = split.filter("isin = 'HOT' AND is_halo").groupBy("chunk").count().toPandas()
    assert halos["count"].max() == 50
    assert split.filter("isin <> 'HOT'").select("chunk").distinct().collect() == [(0,)]


def test_a_day_with_most_rows_is_divided(spark):
    pdf = long_series(2000, 8, holes=.1)
    pdf["datadate"] = np.where(np.arange(2000) < 1900, pdf.datadate[5], pdf.datadate)
    pdf["adj_trading_volume"] = np.floor(np.arange(2000) ** 1.5 / 200)
    pdf.loc[:49, "adj_trading_volume"] = np.nan
    pdf["market_capitalization"] = np.arange(2000) * 1.0
    df = to_spark(spark, pdf)
    for order in (("datadate", "adj_trading_volume", "market_capitalization"), ("datadate",)):
        cut = {"order": order, "split_rows": 500, "chunk_rows": 100}
        split = hot_series.split_hot_series(df, halo_rows=20, **cut)
        sizes = [r["count"] for r in split.groupBy("chunk").count().collect()]
        assert len(sizes) == 20 and max(sizes) <= 120
        options = {"months": (1,), "days_per_month": 7}
        same(series.rolling_volatility(df, **options, **cut),
             series.rolling_volatility(df, **options, order=order, split_rows=None),
             ["market_capitalization"])


def test_a_split_series_scans_the_prices_twice(spark, plan_text, tmp_path):
    """Once for the rows that stay whole in the final plan; the oversized ones are written."""
    to_spark(spark, long_series(1000, 4)).write.parquet(str(tmp_path / "prices"))
    df = spark.read.parquet(str(tmp_path / "prices"))
    text = plan_text(series.daily_features(df, months=(1,), split_rows=500, chunk_rows=100))
    assert text.count(str(tmp_path / "prices")[-20:]) <= 2
    assert "placed-series" in text


def test_no_oversized_series_means_one_range(spark):
    df = to_spark(spark, long_series(100, 1))
    split = hot_series.split_hot_series(df, halo_rows=5)
    assert split.count() == 100
    assert split.filter("chunk <> 0 OR is_halo").count() == 0
    assert set(split.columns) - set(df.columns) == {"chunk", "is_halo", "carried", "offset", "_tie"}
    assert PRICES.split()[0] in split.columns


@settings(max_examples=4, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(30, 120), days=st.integers(3, 60), chunk=st.integers(1, 40),
       seed=st.integers(0, 10**6))
def test_any_cut_gives_the_same_figures(spark, n, days, chunk, seed):
    rng = np.random.default_rng(seed)
    pdf = long_series(n, seed, holes=.3, zeros=.05)
    pdf["datadate"] = np.sort(rng.choice(pd.bdate_range("2000-01-03", periods=days).date, n))
    pdf["adj_trading_volume"] = rng.permutation(n) * 1.0
    df = to_spark(spark, pdf)
    options = {"order": ORDER, "months": (1, 2), "days_per_month": 4}
    same(series.daily_features(df, **options, split_rows=1, chunk_rows=chunk).drop("_opens_month"),
         series.daily_features(df, **options, split_rows=None).drop("_opens_month"),
         ["isin", *ORDER])
    options["back"] = (1,)
    same(factors.price_panel(df, **options, split_rows=1, chunk_rows=chunk),
         factors.price_panel(df, **options, split_rows=None), ["isin", "year"])
