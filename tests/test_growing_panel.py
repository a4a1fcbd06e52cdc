"""A panel that grows by loads equals one of all rows; proposed names equal a comparison of all pairs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import reconcile
from factorloom.plans import factors, growing_panel
from tests.test_hot_series import same
from tests.test_series import long_series, to_spark

OPTIONS = {"months": (1, 3), "days_per_month": 7}
LATER = {"back": (1, 6), "forward": 12}


@pytest.fixture(scope="module")
def prices(spark):
    rng = np.random.default_rng(2)
    series = [long_series(1200, s, holes=.1, isin=f"S{s}") for s in range(4)]
    series[1] = series[1].iloc[:500]                 # ends before the last loads
    series[2] = series[2].iloc[700:]                 # begins after the first
    series[3].loc[300:640, "adj_close_price"] = np.nan  # the last known price lies far back
    pdf = pd.concat(series)
    pdf["adj_trading_volume"] = rng.permutation(len(pdf)) * 1.0
    return to_spark(spark, pdf).cache()


def cuts(prices, n):
    days = sorted(r[0] for r in prices.select("datadate").distinct().collect())
    return [days[k * len(days) // (n + 1)] for k in range(1, n + 1)]


@pytest.mark.parametrize("order", [("datadate",), ("datadate", "adj_trading_volume")])
@pytest.mark.parametrize("loads", [1, 4])
def test_a_panel_of_loads_equals_that_of_all_rows(prices, order, loads):
    edges = [None, *cuts(prices, loads), None]
    state = None
    for low, high in zip(edges, edges[1:]):
        part = prices
        part = part.where(F.col("datadate") >= F.lit(low)) if low else part
        part = part.where(F.col("datadate") < F.lit(high)) if high else part
        state = growing_panel.extend(state, part) if state else growing_panel.begin(part, order, **OPTIONS)
    whole = factors.price_panel(prices, order, split_rows=None, **OPTIONS, **LATER)
    assert whole.count() >= 6
    same(state.panel(**LATER), whole, ["isin", "year"])
    # The state is bounded by the longest frame, whatever the history.
    assert state.tail.groupBy("isin").count().agg(F.max("count")).first()[0] <= state.halo_rows


def test_an_appended_month_reads_the_state_and_the_month_only(prices):
    edge = cuts(prices, 2)[1]
    state = growing_panel.begin(prices.where(F.col("datadate") < F.lit(edge)), **OPTIONS)
    month = prices.where((F.col("datadate") >= F.lit(edge)) & (F.col("datadate") < F.add_months(F.lit(edge), 1)))
    grown = growing_panel.extend(state, month)
    whole = prices.where(F.col("datadate") < F.add_months(F.lit(edge), 1))
    same(grown.panel(**LATER), factors.price_panel(whole, split_rows=None, **OPTIONS, **LATER), ["isin", "year"])
    assert growing_panel.extend(grown, prices.limit(0)).panel(**LATER).count() == grown.panel(**LATER).count()


def test_a_split_beginning_gives_the_same_state(prices):
    edge = cuts(prices, 1)[0]
    early, late = prices.where(F.col("datadate") < F.lit(edge)), prices.where(F.col("datadate") >= F.lit(edge))
    order = ("datadate", "adj_trading_volume")
    cut = growing_panel.begin(early, order, **OPTIONS, split_rows=200, chunk_rows=90)
    whole = growing_panel.begin(early, order, **OPTIONS)
    same(cut.series, whole.series, ["isin"])
    same(growing_panel.extend(cut, late).panel(**LATER), growing_panel.extend(whole, late).panel(**LATER), ["isin", "year"])


def test_known_days_are_refused(prices):
    state = growing_panel.begin(prices, **OPTIONS)
    with pytest.raises(ValueError, match="known already"):
        growing_panel.extend(state, prices.limit(3))


# --- names -----------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("similarity, q", [(0.8, 2), (0.7, 2), (0.9, 3), (1.0, 2)])
def test_similar_names_equal_a_comparison_of_all_pairs(spark, similarity, q):
    rng = random.Random(q)
    letters = "aabbcdé"

    def name():
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))

    def misspelt(x):
        at = rng.randrange(len(x)) if x else 0
        return rng.choice([x[:at] + x[at + 1:], x[:at] + "z" + x[at:], x[:at] + "q" + x[at + 1:], x])
    known = [name() for _ in range(120)] + ["aaaaaaaaaa", "a", ""]
    wanted = [misspelt(misspelt(x)) for x in known if x][:100] + ["aaaaaaaaab", "", None]
    frames = [spark.createDataFrame([(x,) for x in side], "name string") for side in (wanted, known)]
    found = {(r.left, r.right, r.distance) for r in reconcile.similar_names(*frames, similarity, q).collect()}
    expected = {(a, b, d) for a in set(wanted) - {"", None} for b in set(known) - {""}
                for d in [distance(a, b)] if d <= max(len(a), len(b)) * (1 - similarity) + 1e-9}
    assert found == expected and found


def test_proposals_for_names_typed_by_hand(spark):
    wanted = spark.createDataFrame([("Viet Nam",), ("Kyrgyzstan",), ("Swaziland, Kingdom",), (None,)], "country string")
    known = spark.createDataFrame([("Vietnam", "VNM"), ("Kyrgyz-stan", "KGZ"), ("Kenya", "KEN"), ("VIETNAM!", "VN2")],
                                  "table_name string, code string")
    found = sorted(map(tuple, reconcile.propose_repairs(wanted, known, "country", "table_name", "code").collect()))
    assert found == [("Kyrgyzstan", "Kyrgyz-stan", "KGZ", 0), ("Viet Nam", "VIETNAM!", "VN2", 0),
                     ("Viet Nam", "Vietnam", "VNM", 0)]
    with pytest.raises(ValueError):
        reconcile.similar_names(wanted, known, 0.4)
