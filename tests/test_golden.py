"""The published scatter: income and life expectancy of 191 countries, and its line."""

import numpy as np
import pytest

from factorloom.operators import ranks, regression

# Gross national income per capita, and life expectancy at birth.
INCOME = [
    66933.00454, 64660.10622, 55782.04981, 62606.8454, 49238.43335, 60364.78595, 54489.37401,
    76168.98443, 54534.21682, 55979.411, 49452.16672, 90918.64471, 52293.39977, 44057.31394,
    46807.98619, 146829.7006, 84649.47467, 45224.76564, 42274.29134, 44500.93187, 64765.21509,
    41523.74319, 38884.45623, 39746.01987, 53618.67138, 62573.59181, 38353.60164, 45937.05273,
    38188.42152, 42839.51441, 38048.26372, 38745.21386, 29002.48545, 33033.96081, 39497.24788,
    37931.30359, 46111.55135, 33154.53343, 32803.23423, 51166.62661, 30132.28814, 24563.24486,
    87134.13469, 52653.82534, 30690.48552, 32789.01063, 20925.26814, 31032.80106, 20838.80129,
    52919.76137, 64489.53954, 27166.30891, 30027.29131, 27054.32505, 30486.18429, 23942.81837,
    23392.02084, 19974.27358, 21268.88122, 18848.96704, 26956.83707, 26657.94355, 14664.16825,
    22025.34631, 19123.02747, 17030.15352, 14131.11039, 23078.95595, 13483.5774, 12306.341,
    16792.36595, 25830.61775, 12578.22055, 15241.91465, 23358.33212, 13000.7117, 13255.50977,
    15917.75283, 17504.39969, 17989.60037, 14875.33189, 13818.67869, 7878.847482, 12245.89366,
    13157.9939, 17896.29498, 14369.88848, 14384.35666, 11961.08792, 15448.12788, 10800.22546,
    14256.74456, 6822.03125, 13020.7155, 10311.63273, 10588.22532, 11731.69056, 10257.54477,
    9980.110866, 12672.20033, 7916.785725, 11487.62422, 9923.714974, 15335.712, 12349.286,
    6582.899416, 12048.30381, 22464.65734, 12948.37325, 8834.47567, 5307.953374, 13366.93455,
    9525.831467, 11466.06836, 7867.371345, 8920.428468, 16198.31841, 8111.190194, 4566.303831,
    4810.882621, 9977.249073, 4547.742427, 6309.099778, 7302.81917, 8295.665889, 5624.793595,
    9437.541512, 6230.200199, 5472.104781, 6351.435899, 4619.535393, 6589.980037, 5744.504017,
    3696.173945, 8723.285317, 4062.586034, 5297.955301, 4021.350815, 8633.504452, 7699.579617,
    4460.869435, 3085.411633, 3877.315444, 7678.591873, 12073.95993, 4078.697154, 3809.887158,
    5465.617791, 3850.524234, 4191.933893, 3620.932408, 4473.570344, 2889.283521, 3217.767739,
    2481.511362, 3142.064119, 4008.623573, 5075.305711, 5217.448516, 2664.329096, 4623.70543,
    2166.619062, 2847.500746, 4790.284425, 2209.795202, 3408.965923, 2181.43651, 2700.435748,
    1465.635064, 3344.311825, 5024.993944, 3575.19084, 1483.520983, 2172.207664, 2361.069604,
    1728.742667, 1908.24159, 1288.74235, 1076.098781, 1824.190915, 1621.512579, 2480.887182,
    1314.270189, 2117.915916, 1198.073924, 2132.629443, 731.7867086, 966.0586107, 1239.866936,
    1364.169417, 767.787]
LIFE = [
    83.9872, 83.2339, 82.6782, 85.4734, 84.5265, 81.3753, 82.9833, 81.9976, 80.6301, 81.6873,
    82.0381, 82.7545, 81.8787, 82.4513, 82.6565, 83.2575, 82.6287, 80.7422, 84.7839, 83.6978,
    77.1982, 82.255, 83.7769, 80.6904, 81.5797, 78.7104, 83.01, 82.4988, 81.2033, 82.8502,
    77.1436, 77.7283, 80.1106, 76.4572, 78.7605, 73.7201, 76.936, 81.0443, 73.5786, 80.3684,
    77.5804, 78.9435, 79.2716, 80.8786, 74.9101, 74.5301, 75.3899, 76.0324, 76.3426, 78.6729,
    74.6424, 69.419, 74.1847, 72.5406, 71.5983, 69.3622, 72.9709, 77.0232, 75.4356, 72.438,
    76.2233, 74.8839, 71.694, 73.5552, 74.1923, 78.7154, 76.4626, 71.798, 74.9362, 77.5714,
    78.4968, 71.2945, 76.3991, 75.3003, 71.6822, 73.8749, 71.624, 73.8415, 78.2107, 72.6146,
    68.8459, 66.0204, 73.6829, 72.3769, 72.0431, 70.2127, 72.7504, 72.8296, 69.6291, 79.9182,
    76.3767, 69.3658, 70.9857, 69.2644, 73.67, 70.9754, 70.2207, 73.7719, 67.114, 70.2743,
    70.8616, 72.814, 74.2563, 71.9112, 70.2617, 73.4727, 71.1114, 65.6734, 62.341, 70.5003,
    72.7675, 65.821, 75.0472, 67.5703, 73.6181, 69.2664, 61.1409, 63.6304, 69.9774, 70.5536,
    70.3779, 71.5942, 70.4697, 74.0419, 70.7479, 73.8368, 71.815, 74.0518, 72.3811, 64.5466,
    65.2688, 67.2398, 63.7954, 70.71, 69.2368, 67.4172, 70.1229, 67.5912, 59.269, 68.0608,
    67.7369, 70.449, 68.4495, 57.0657, 60.5943, 69.5835, 59.2531, 61.6434, 65.6716, 72.0627,
    60.3334, 61.427, 63.5187, 61.2234, 70.3477, 63.4174, 65.3506, 64.3636, 58.5983, 66.2007,
    66.0979, 61.6194, 63.1924, 52.676, 66.0722, 59.821, 62.7048, 53.062, 62.9044, 67.0926,
    62.3049, 65.2667, 64.4853, 62.083, 64.9748, 66.5358, 59.6523, 60.7472, 59.193, 61.9824,
    60.0624, 58.8922, 63.7534, 59.2696, 59.3247, 58.9414, 61.6627, 53.8947, 61.5763, 52.5254,
    54.9752]
SLOPE, INTERCEPT, SPEARMAN = 2.57618348e-04, 66.0963235, 0.850478782033618


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(list(zip(INCOME, LIFE)), "x double, y double")


def test_line_of_the_scatter(points):
    row = regression.linear_fit(points, "x", "y").first()
    assert row.n == 191
    assert row.slope == pytest.approx(SLOPE, rel=1e-8)
    assert row.intercept == pytest.approx(INTERCEPT, rel=1e-8)


def test_points_on_the_line(points):
    fit = regression.linear_fit(points, "x", "y")
    drawn = regression.fit_line_points(fit).orderBy("point").toPandas()
    at = np.linspace(min(INCOME), max(INCOME), 50)
    np.testing.assert_allclose(drawn.x, at, rtol=1e-12)
    np.testing.assert_allclose(drawn.y, SLOPE * at + INTERCEPT, rtol=1e-8)


def test_rank_correlation_of_the_scatter(points):
    row = ranks.spearman(points, "x", "y").first()
    assert row.n == 191 and row.spearman == pytest.approx(SPEARMAN, abs=1e-12)
