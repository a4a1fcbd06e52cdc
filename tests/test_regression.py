import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from factorloom.operators import crosssec, regression


def data(n, k, seed, country="X"):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k))
    y = x @ rng.normal(size=k) * .3 + rng.normal(size=n)
    out = pd.DataFrame(x, columns=[f"f{i}" for i in range(k)])
    out.insert(0, "country", country)
    return out.assign(y=y)


def fit(spark, pdf, **options):
    names = [c for c in pdf.columns if c.startswith("f")]
    df = spark.createDataFrame(pdf).repartition(5)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c != "country" else c
                     for c in df.columns])
    out = regression.ols_grouped(df, names, "y", **options).toPandas()
    return out.sort_values(["country", "factor"]).reset_index(drop=True)


def test_matches_spark_ml(spark):
    pdf = data(400, 4, 1)
    df = VectorAssembler(inputCols=["f0", "f1", "f2", "f3"], outputCol="v") \
        .transform(spark.createDataFrame(pdf))
    model = LinearRegression(featuresCol="v", labelCol="y", fitIntercept=False, solver="normal",
                             regParam=0.0).fit(df)
    got = fit(spark, pdf)
    np.testing.assert_allclose(got.beta, model.coefficients.toArray(), rtol=1e-10)
    np.testing.assert_allclose(got.pvalue, model.summary.pValues, rtol=1e-6, atol=1e-12)
    assert set(got.n_obs) == {400} and set(got.df_resid) == {396} and set(got["rank"]) == {4}


def test_groups_are_fitted_apart_and_a_third_of_the_rows_in_one_is_fine(spark):
    parts = [data(3000, 3, 2, "big"), data(40, 3, 3, "small"), data(50, 3, 4, "other")]
    got = fit(spark, pd.concat(parts))
    for part in parts:
        x = part[["f0", "f1", "f2"]].to_numpy()
        beta = np.linalg.lstsq(x, part.y, rcond=None)[0]
        np.testing.assert_allclose(got[got.country == part.country.iloc[0]].beta, beta, rtol=1e-10)


def test_ill_conditioned_design_keeps_its_accuracy(spark):
    pdf = data(300, 3, 5)
    pdf["f2"] = pdf.f1 + 1e-6 * pdf.f2
    x = pdf[["f0", "f1", "f2"]].to_numpy()
    got = fit(spark, pdf)
    np.testing.assert_allclose(got.beta, np.linalg.lstsq(x, pdf.y, rcond=None)[0], rtol=1e-7)
    assert set(got["rank"]) == {3}


def test_collinear_factors_are_flagged_and_get_the_shortest_solution(spark):
    pdf = data(200, 2, 6)
    pdf["f2"] = pdf.f0 - pdf.f1
    got = fit(spark, pdf)
    beta = np.linalg.pinv(pdf[["f0", "f1", "f2"]].to_numpy()) @ pdf.y.to_numpy()
    assert set(got["rank"]) == {2} and set(got.df_resid) == {198}
    np.testing.assert_allclose(got.beta, beta, rtol=1e-9)


def test_too_few_rows_give_no_coefficients(spark):
    got = fit(spark, data(3, 3, 7))
    assert len(got) == 3 and got.beta.isna().all() and got.pvalue.isna().all()


@pytest.mark.parametrize("share, kept", [(.19, True), (.20, False), (1.0, False)])
def test_columns_are_dropped_from_a_fifth_of_missing_values(spark, share, kept):
    pdf = data(100, 3, 8)
    pdf.loc[:round(share * 100) - 1, "f1"] = np.nan
    got = fit(spark, pdf)
    assert ("f1" in set(got.factor)) is kept
    assert set(got.n_obs) == ({81} if kept else {100})


def test_columns_are_dropped_per_country(spark):
    a, b = data(100, 2, 9, "a"), data(100, 2, 10, "b")
    a["f1"] = np.nan
    got = fit(spark, pd.concat([a, b]))
    assert set(zip(got.country, got.factor)) == {("a", "f0"), ("b", "f0"), ("b", "f1")}


def test_gram_sums_equal_products(spark):
    pdf = data(500, 3, 11)
    columns = ["f0", "f1", "f2", "y"]
    got = regression.gram_sums(spark.createDataFrame(pdf).repartition(7), columns, "country")
    expected = pdf[columns].to_numpy().T @ pdf[columns].to_numpy()
    rows = got.collect()
    assert len(rows) == 10
    for r in rows:
        assert r.total == pytest.approx(expected[columns.index(r.row), columns.index(r.col)],
                                        rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("t, df, p", [
    (0.0, 5, 1.0), (1.0, 1, 0.5), (12.706204736432095, 1, 0.05), (2.0, 2, 0.18350341907227397),
    (1.959963984540054, 1e7, 0.05), (2.228138851964939, 10, 0.05), (-2.228138851964939, 10, 0.05),
    (math.inf, 4, 0.0)])
def test_p_values(t, df, p):
    assert regression.student_p_value(t, df) == pytest.approx(p, rel=1e-6)


def test_p_value_by_integration():
    for df in (3, 17, 139, 2947):
        for t in (0.01, 0.7, 1.65, 3.2, 6.0):
            x = np.linspace(0, t, 200001)
            c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
            y = c * (1 + x * x / df) ** (-(df + 1) / 2)
            area = np.sum((y[1:] + y[:-1]) / 2) * (x[1] - x[0])
            assert regression.student_p_value(t, df) == pytest.approx(1 - 2 * area, abs=2e-9)


def test_fitted_line_ends(spark):
    """A known fit: the ends of its line, and points that lie on it."""
    slope, intercept = 2.5761834824e-04, 66.0963235
    xs = np.linspace(731.7867086, 146829.7006, 191)
    df = spark.createDataFrame([(float(x), float(slope * x + intercept)) for x in xs],
                               "gni double, life double")
    fit_row = regression.linear_fit(df, "gni", "life")
    points = regression.fit_line_points(fit_row).orderBy("point").collect()
    assert len(points) == 50
    assert (points[0].x, points[-1].x) == (731.7867086, 146829.7006)
    assert points[0].y == pytest.approx(66.2848452265526, abs=1e-6)
    assert points[-1].y == pytest.approx(103.92234851979336, abs=1e-4)


def test_scores_have_mean_zero_and_deviation_one(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"exchg": rng.choice(["a", "b"], 200), "isin": range(200),
                        "year": rng.choice([2000, 2001], 200), "v": rng.normal(5, 3, 200)})
    out = crosssec.normalize_cross_section(spark.createDataFrame(pdf), ["v"]).toPandas()
    by = out.groupby(["exchg", "year"]).v
    assert by.mean().abs().max() < 1e-12 and (by.std() - 1).abs().max() < 1e-12


def test_scores_of_single_and_constant_groups_are_missing(spark):
    df = spark.createDataFrame([("a", "x", 2000, 1.0, 1.0), ("b", "x", 2000, 2.0, .1),
                                ("b", "y", 2000, 2.0, .3), ("b", "z", 2000, 2.0, None)],
                               "exchg string, isin string, year int, v double, w double")
    rows = crosssec.normalize_cross_section(df, ["v", "w"]).orderBy("exchg", "isin").collect()
    assert [r.v for r in rows] == [None] * 4
    assert rows[0].w is None and rows[3].w is None
    assert rows[1].w == pytest.approx(-math.sqrt(.5))


def test_null_ratios_follow_from_the_group_summaries(spark):
    rng = np.random.default_rng(4)
    v, w = rng.normal(size=300), rng.normal(size=300)
    v[rng.random(300) < .3] = np.nan
    exchg = rng.choice(["a", "b", "c"], 300)
    w[exchg == "b"] = 4.0
    rows = [(e, int(i), int(2000 + i % 3), None if np.isnan(x) else float(x), float(z))
            for i, (e, x, z) in enumerate(zip(exchg, v, w))]
    rows.append(("d", 999, 2000, 1.0, 1.0))
    df = spark.createDataFrame(rows, "exchg string, isin int, year int, v double, w double")
    home = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y"), ("d", "Z")],
                                 "exchg string, country string")
    panel = df.join(home, "exchg")
    stats = crosssec.cross_section_stats(panel, ["v", "w"])
    short = crosssec.score_null_ratios(stats.join(home, "exchg"), ["v", "w"])
    full = crosssec.null_ratios(crosssec.normalize_cross_section(panel, ["v", "w"]), ["v", "w"],
                                ("country",))
    assert {tuple(r) for r in short.collect()} == {tuple(r) for r in full.collect()}


def test_cutoffs_do_not_depend_on_the_number_of_rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 3))
    x[:, 2] = x[:, 1] + 1e-8 * rng.normal(size=50)
    factor = np.linalg.qr(np.column_stack([x, rng.normal(size=50)]), mode="r")
    few, many = (regression._solve(n, factor, [0, 1, 2], list("abc")) for n in (50, 10**10))
    assert [r[1] for r in few] == [r[1] for r in many]
    assert {r[5] for r in few} == {r[5] for r in many} == {3}


@pytest.mark.parametrize("t", [0.3, 1.645, 2.5, 5.0])
@pytest.mark.parametrize("df", [1e6, 1e8, 1e10, 1e12])
def test_p_values_with_many_degrees_of_freedom(t, df):
    """Against the normal tail with the first term of the expansion in 1 / df."""
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    expected = math.erfc(t / math.sqrt(2)) + density * (t ** 3 + t) / (2 * df)
    assert regression.student_p_value(t, df) == pytest.approx(expected, abs=1e-10)


def test_p_values_join_where_the_method_changes():
    for t in (0.01, 1.0, 1.645, 4.0):
        below = regression.student_p_value(t, regression.LARGE_DF)
        above = regression.student_p_value(t, regression.LARGE_DF * (1 + 1e-9))
        assert below == pytest.approx(above, rel=1e-9)


def test_groups_beyond_the_bound_are_passed_on_in_parts(spark):
    parts = pd.concat([data(40, 2, k, f"c{k}") for k in range(12)])
    df = spark.createDataFrame(parts).repartition(3)
    held = regression.partial_factors(df, ["f0", "f1", "y"], "country", max_held=5)
    assert held.count() >= 12
    got = fit(spark, parts)
    assert got.country.nunique() == 12


def test_a_fraction_that_does_not_converge_is_an_error(monkeypatch):
    monkeypatch.setattr(regression, "MAX_DEPTH", 8)
    with pytest.raises(ArithmeticError):
        regression.student_p_value(1.0, 10.0)
