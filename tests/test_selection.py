"""Quantiles and rank correlations of many columns and groups against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import selection


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    n = 6000
    pdf = pd.DataFrame({
        "g": np.where(rng.random(n) < .6, "hot", rng.choice(list("abc"), n)),
        "wide": rng.standard_normal(n) * 10.0 ** rng.integers(-12, 12, n),
        "ties": rng.integers(0, 5, n) * 1.0, "same": 3.5, "none": np.nan,
        "far": np.where(np.arange(n) == 5, 1.7e308, np.where(np.arange(n) == 6, -1.7e308, rng.random(n))),
        "target": rng.standard_normal(n)})
    pdf.loc[rng.random(n) < .2, "wide"] = np.nan
    pdf.loc[rng.random(n) < .1, "target"] = np.nan
    pdf.loc[0, "g"] = None
    return pdf


COLUMNS = ["wide", "ties", "same", "none", "far"]


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf.replace({np.nan: None}).astype({"g": object}),
                               "g string, wide double, ties double, same double, none double, far double, target double")
    return df.repartition(5)


@pytest.mark.parametrize("few", [3, 200, 5000])
def test_quantiles_equal_numpy(spark, table, few):
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    found = {(r.g, r.column): r for r in selection.group_quantiles(
        to_spark(spark, table), ["g"], COLUMNS, probabilities, few).collect()}
    expected = {(g, c): rows[c].dropna() for g, rows in table.groupby("g", dropna=False) for c in COLUMNS}
    assert {k for k in found} == {(None if isinstance(g, float) else g, c) for (g, c), v in expected.items() if len(v)}
    for (g, c), values in expected.items():
        if len(values):
            row = found[None if isinstance(g, float) else g, c]
            assert row.n == len(values)
            at = [(len(values) - 1) * p for p in probabilities]
            ordered = np.sort(values.to_numpy())
            low, high = ordered[np.floor(at).astype(int)], ordered[np.ceil(at).astype(int)]
            with np.errstate(over="ignore"):
                wanted = low + (np.array(at) - np.floor(at)) * (high - low)
            np.testing.assert_allclose(row.quantiles, wanted, rtol=1e-12)


def test_quantiles_of_no_rows(spark, table):
    assert selection.group_quantiles(to_spark(spark, table).limit(0), ["g"], COLUMNS).count() == 0
    assert selection.spearman_matrix(to_spark(spark, table).limit(0), ["g"], COLUMNS, "target").count() == 0


def test_rank_correlations_equal_pandas(spark, table):
    rows = table.dropna(subset=["g"])
    found = {(r.g, r.column): r for r in selection.spearman_matrix(
        to_spark(spark, table).where(F.col("g").isNotNull()), ["g"], COLUMNS, "target").collect()}
    for g, part in rows.groupby("g"):
        for c in COLUMNS:
            both = part[[c, "target"]].dropna()
            if not len(both):
                assert (g, c) not in found
                continue
            assert found[g, c].n == len(both)
            expected = both.rank().corr().iloc[0, 1]
            if np.isnan(expected):
                assert found[g, c].spearman is None or np.isnan(found[g, c].spearman)
            else:
                assert abs(found[g, c].spearman - expected) < 1e-9
