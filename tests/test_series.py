import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import series
from factorloom.plans import factors

PRICES = ("exchg string, isin string, datadate date, adj_close_price double, "
          "adj_trading_volume double, market_capitalization double, dividend_per_share double")


def day(text):
    return datetime.date.fromisoformat(text)


def frame(spark, rows):
    """rows: (isin, date, price, volume, capitalization, dividend)"""
    return spark.createDataFrame(
        [("1", r[0], day(r[1]), *(list(r[2:]) + [None] * (6 - len(r)))) for r in rows], PRICES)


def long_series(n, seed, holes=0.0, zeros=0.0, isin="A"):
    rng = np.random.default_rng(seed)
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    price = np.where(rng.random(n) < zeros, 0.0, price)
    price = np.where(rng.random(n) < holes, np.nan, price)
    dates = pd.bdate_range("2000-01-03", periods=n)
    return pd.DataFrame({"exchg": "1", "isin": isin, "datadate": dates.date,
                         "adj_close_price": price, "adj_trading_volume": rng.integers(1, 90, n) * 1.0,
                         "market_capitalization": price * 10,
                         "dividend_per_share": np.where(rng.random(n) < .9, np.nan, 1.0)})


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), PRICES)


def test_returns_fill_missing_prices_and_skip_zero_denominators(spark):
    df = frame(spark, [("A", "2000-01-03", None), ("A", "2000-01-04", 10.0),
                       ("A", "2000-01-05", None), ("A", "2000-01-06", 20.0),
                       ("A", "2000-01-07", 0.0), ("A", "2000-01-10", 5.0)])
    got = [r.daily_return for r in series.daily_returns(df).orderBy("datadate").collect()]
    assert got == [None, None, 0.0, 1.0, -1.0, None]


def test_rolling_matches_pandas_on_long_series(spark):
    pdf = pd.concat([long_series(900, 1, isin="A"), long_series(30, 2, isin="B")])
    months = (1, 3, 36)
    got = series.rolling_volatility(to_spark(spark, pdf), months=months).toPandas()
    liq = series.rolling_liquidity(to_spark(spark, pdf), months=months).toPandas()
    for isin, part in pdf.groupby("isin"):
        returns = part.adj_close_price.pct_change()
        amount = part.adj_close_price * part.adj_trading_volume
        mine = got[got["isin"] == isin].sort_values("datadate")
        other = liq[liq["isin"] == isin].sort_values("datadate")
        for m in months:
            w = 21 * m + 1
            np.testing.assert_allclose(mine[f"daily_vol_{m}m"], returns.rolling(w).std(), rtol=1e-9)
            np.testing.assert_allclose(other[f"avg_transaction_amount_{m}m"],
                                       amount.rolling(w, min_periods=1).mean(), rtol=1e-9)


def test_rolling_leaves_no_residue_of_an_outlier_and_sees_constant_frames(spark):
    price = [1e-8, 1e8] + [100.0 * 1.25 ** (i % 2) for i in range(60)] + [7.0] * 40
    rows = [("A", str(d.date()), p, 1.0) for d, p in
            zip(pd.bdate_range("2000-01-03", periods=len(price)), price)]
    got = series.rolling_volatility(frame(spark, rows), months=(1,)).orderBy("datadate").collect()
    values = [r.daily_vol_1m for r in got]
    assert values[-1] == 0.0
    assert values[40] == pytest.approx(np.std([0.25, -0.2] * 11, ddof=1), rel=1e-12)


def test_a_missing_return_empties_every_frame_that_holds_it(spark):
    pdf = long_series(60, 3)
    pdf.loc[30, "adj_close_price"] = 0.0     # makes the return of row 31 undefined
    rows = series.rolling_volatility(to_spark(spark, pdf), months=(1,)).orderBy("datadate").collect()
    empty = [i for i, r in enumerate(rows) if r.daily_vol_1m is None]
    assert empty == list(range(22)) + list(range(31, 53))


@pytest.mark.parametrize("lengths", [(1,), (21,), (21, 63, 126, 252, 504, 756), (2, 500), (5, 7, 700)])
def test_frame_plan_pieces_cover_each_frame_once(lengths):
    seen = {1}
    for level in series.frame_plan(lengths):
        for length, pieces in level:
            covered = [at + i for at, piece in pieces for i in range(piece)]
            assert covered == list(range(length))
            assert all(piece in seen for _, piece in pieces)
        seen |= {length for length, _ in level}
    assert set(lengths) <= seen


def test_snapshot_takes_first_non_null_january_value_of_each_column(spark):
    df = frame(spark, [("A", "2000-01-03", 1.0, None, None, None),
                       ("A", "2000-01-04", 2.0, None, 20.0, None),
                       ("A", "2000-02-01", 3.0, 1.0, 30.0, 0.5),
                       ("B", "2000-02-01", 3.0, 1.0, 30.0, 0.5)])
    rows = series.january_snapshot(df, ["adj_close_price", "market_capitalization",
                                        "dividend_per_share"]).collect()
    assert [tuple(r) for r in rows] == [("1", "A", 2000, day("2000-01-03"), 1.0, 20.0, None)]


def test_month_anchor_keeps_first_day_even_without_a_price(spark):
    df = frame(spark, [("A", "2000-01-05", 9.0), ("A", "2000-01-03", None)])
    row = series.month_anchor(df).first()
    assert (row.anchor_date, row.anchor_price, row.month_no) == (day("2000-01-03"), None, 24000)


def test_momentum_needs_every_horizon_exactly(spark):
    months = pd.date_range("1996-12-01", "2001-02-01", freq="MS")
    rows = [("A", str(d.date()), 100.0 + i) for i, d in enumerate(months)]
    full = factors.momentum(frame(spark, rows)).collect()
    assert [r.year for r in full] == [2000]
    at = {str(d.date()): 100.0 + i for i, d in enumerate(months)}
    assert full[0].momentum_36m == (at["2000-01-01"] - at["1997-01-01"]) / at["1997-01-01"]
    assert full[0].return_1y_later == (at["2001-01-01"] - at["2000-01-01"]) / at["2000-01-01"]
    without = [r for r in rows if not r[1].startswith("1999-07")]
    assert factors.momentum(frame(spark, without)).count() == 0


def test_growth_compares_rows_and_can_ask_for_consecutive_years(spark):
    q = spark.createDataFrame(
        [("1", "A", y, day("2000-01-01"), a, a, a, a, a) for y, a in
         [(2000, 10.0), (2001, None), (2002, 15.0), (2004, 30.0)]],
        "exchg string, isin string, year int, datadate date, assets double, revenue double, "
        "operating_income double, earnings_before_interest double, cash_flow double")
    rows = {r.year: r.assets_yoy for r in factors.growth(q).collect()}
    assert rows == {2000: None, 2001: 0.0, 2002: 0.5, 2004: 1.0}
    strict = {r.year: r.assets_yoy for r in factors.growth(q, True).collect()}
    assert strict == {2000: None, 2001: 0.0, 2002: 0.5, 2004: None}


def test_value_ratio_of_a_zero_item_is_missing(spark):
    keys = "exchg string, isin string, year int, datadate date"
    q = spark.createDataFrame([("1", "A", 2002, day("2000-06-30"), 0.0, 2.0, -4.0, None, 1.0)],
                              keys + ", assets double, revenue double, operating_income double, "
                              "earnings_before_interest double, cash_flow double")
    s = spark.createDataFrame([("1", "A", 2002, day("2002-01-02"), 8.0)],
                              keys + ", market_capitalization double")
    row = factors.value(q, s).first()
    assert (row.pbr, row.psr, row.por, row.per, row.pcr) == (None, 4.0, -2.0, None, 8.0)
    assert row.datadate == day("2002-01-02")


def test_scaling_prices_changes_neither_momentum_nor_volatility(spark):
    pdf = long_series(1400, 5)
    df = to_spark(spark, pdf)
    scaled = df.withColumn("adj_close_price", F.col("adj_close_price") * 8.0)
    for family in (factors.momentum, factors.volatility):
        a, b = (family(d).orderBy("year").drop("datadate").toPandas() for d in (df, scaled))
        pd.testing.assert_frame_equal(a, b, rtol=1e-12)


def test_one_pass_panel_equals_the_merged_families(spark):
    pdf = pd.concat([long_series(1500, 6, holes=.05, isin="A"),
                     long_series(1500, 7, zeros=.001, isin="B")])
    df = to_spark(spark, pdf)
    merged = factors.merge_families([factors.size(df), factors.dividend_yield(df),
                                     factors.volatility(df), factors.liquidity(df),
                                     factors.momentum(df)])
    one = factors.price_panel(df)
    key = ["isin", "year"]
    a = merged.select(one.columns).toPandas().sort_values(key).reset_index(drop=True)
    b = one.toPandas().sort_values(key).reset_index(drop=True)
    assert len(a) > 2 and math.isfinite(b.daily_vol_36m.dropna().iloc[0])
    pd.testing.assert_frame_equal(a, b, rtol=1e-12)
