"""Line fit, and least squares per group without moving the rows of a group.

Each task reduces its rows of a group to one triangular factor R of the design
matrix with the response as last column (R'R equals the cross-product matrix).
Stacking factors and factoring again merges them, so the factors are combined in
a tree and only the last, small one is solved.  Unlike sums of products this
keeps the accuracy of a decomposition of the full matrix.  A group of any size
costs each task one k by k matrix.  A task holds the matrices of at most ``MAX_HELD``
groups at a time; beyond that it passes them on, as parts of a group merge anyway.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.scalars import line_value
from factorloom.operators.crosssec import complete_rows, kept_factors, null_ratios

MAX_HELD = 256
COEFFICIENT_CUTOFF = 1e-15
LARGE_DF = 1e5
MAX_DEPTH = 1 << 16


# --- one regressor -----------------------------------------------------------

def linear_fit(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Slope and intercept of the least-squares line, with the range of x."""
    pairs = complete_rows(df, [x, y])
    x, y = F.col(x).cast("double"), F.col(y).cast("double")
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"))


def fit_line_points(fit: DataFrame, points: int = 50) -> DataFrame:
    """Evenly spaced points on each fitted line, both ends included."""
    step = (F.col("x_max") - F.col("x_min")) / float(points - 1)
    placed = fit.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    placed = placed.withColumn("x", F.when(F.col("point") == points - 1, F.col("x_max"))
                               .otherwise(F.col("x_min") + F.col("point") * step))
    placed = placed.withColumn("y", line_value("slope", "intercept", "x"))
    return placed.drop("n", "slope", "intercept", "x_min", "x_max")


# --- many regressors ---------------------------------------------------------

def student_p_value(t: float, df: float) -> float:
    """Two-sided tail probability of Student's t, by the incomplete beta function.

    With many degrees of freedom, where differences of log-gammas cancel, t is
    turned into a normal deviate by Hill's expansion; its error there is far
    below 1e-12.
    """
    if not math.isfinite(t):
        return math.nan if math.isnan(t) else 0.0
    if df > LARGE_DF:
        a = df - 0.5
        z = math.sqrt(a * math.log1p(t * t / df))
        z += (z ** 3 + 3.0 * z) / (48.0 * a * a)
        return math.erfc(z / math.sqrt(2.0))
    x = df / (df + t * t)
    return _incomplete_beta(df / 2.0, 0.5, x)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log1p(-x))
    # Continued fraction, evaluated from the tail until two depths agree.
    depth, previous = 16, math.inf
    while depth <= MAX_DEPTH:
        tail = 1.0
        for m in range(depth, 0, -1):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            tail = 1.0 + even / (1.0 + odd / tail)
        value = 1.0 / (1.0 - (a + b) * x / (a + 1.0) / tail)
        if abs(value - previous) <= 1e-15 * abs(value):
            return math.exp(log_front) * value / a
        depth, previous = depth * 2, value
    raise ArithmeticError(f"the incomplete beta function did not converge at a={a}, b={b}, x={x}")


def _reduce(rows: np.ndarray) -> np.ndarray:
    """Triangular factor of ``rows``, padded to a square."""
    width = rows.shape[1]
    factor = np.linalg.qr(rows, mode="r")
    if factor.shape[0] < width:
        factor = np.vstack([factor, np.zeros((width - factor.shape[0], width))])
    return factor


def _partials(by: str, names: list[str], max_held: int):
    def run(batches):
        # The partition number stays the same when a lost task is run again.  With
        # the root of it as slot, neither level of the tree has more than about
        # twice the root of the number of tasks to merge.
        slot, held = math.isqrt(TaskContext.get().partitionId()), {}

        def passed_on() -> pd.DataFrame:
            return pd.DataFrame({
                by: list(held), "n_obs": [n for n, _ in held.values()],
                "factor": [f.ravel() for _, f in held.values()], "slot": slot})

        for batch in batches:
            for group, rows in batch.groupby(by, sort=False):
                block = rows[names].to_numpy(dtype=float)
                n, factor = held.get(group, (0, None))
                stacked = block if factor is None else np.vstack([factor, block])
                held[group] = (n + len(block), _reduce(stacked))
                if len(held) >= max_held:
                    yield passed_on()
                    held.clear()
        if held:
            yield passed_on()
    return run


def _stack(rows: pd.DataFrame, width: int) -> tuple[int, np.ndarray]:
    factors = np.vstack([np.asarray(f, dtype=float).reshape(width, width) for f in rows["factor"]])
    return int(rows["n_obs"].sum()), _reduce(factors)


def _combiner(by: str, width: int):
    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        n, factor = _stack(rows, width)
        return pd.DataFrame({by: [rows[by].iloc[0]], "n_obs": [n], "factor": [factor.ravel()]})
    return combine


def _factor_schema(design: DataFrame, by: str) -> str:
    return f"`{by}` {design.schema[by].dataType.simpleString()}, n_obs bigint, factor array<double>"


def partial_factors(design: DataFrame, columns, by: str, max_held: int = MAX_HELD) -> DataFrame:
    """Few rows (by, n_obs, factor) per group, about the root of the number of tasks;
    ``columns`` are free of NULLs."""
    columns, schema = list(columns), _factor_schema(design, by)
    parts = (design.filter(F.col(by).isNotNull()).select(by, *columns)
             .mapInPandas(_partials(by, columns, max_held), schema + ", slot bigint"))
    return parts.groupBy(by, "slot").applyInPandas(_combiner(by, len(columns)), schema)


def grouped_factors(design: DataFrame, columns, by: str) -> DataFrame:
    """One row (by, n_obs, factor) per group."""
    return partial_factors(design, columns, by).groupBy(by).applyInPandas(
        _combiner(by, len(list(columns))), _factor_schema(design, by))


def masked_design(scored: DataFrame, factors, target: str, by: str, kept: DataFrame) -> DataFrame:
    """Complete cases per group; factors a group does not keep are 0.

    ``kept`` has one row per group with the array of its factors.
    """
    joined = scored.join(kept, by)
    masked = [F.when(F.array_contains("kept", f), F.col(f)).otherwise(0.0).alias(f)
              for f in factors]
    return complete_rows(joined.select(by, "kept", *masked, target), [*factors, target])


def gram_sums(design: DataFrame, columns, by: str) -> DataFrame:
    """Cross-product sums per group in long form, upper triangle (row, col, total)."""
    columns = list(columns)
    width = len(columns)
    position = F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(width * width - 1)),
        lambda at: F.aggregate(
            F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0.0),
            lambda total, k: total
            + F.get("factor", k * width + F.floor(at / width).cast("int"))
            * F.get("factor", k * width + at % width))))
    names = F.array(*[F.lit(c) for c in columns])
    return (grouped_factors(design, columns, by).select(by, "n_obs", position.alias("at", "total"))
            .withColumns({"i": F.floor(F.col("at") / width).cast("int"),
                          "j": F.col("at") % width})
            .filter("i <= j")
            .select(by, "n_obs", F.get(names, F.col("i")).alias("row"),
                    F.get(names, F.col("j")).alias("col"), "total"))


def _solve(n: int, factor: np.ndarray, used: list[int], names: list[str]):
    """Coefficients and p-values from the triangular factor; the last column is the response."""
    x, y = factor[:, used], factor[:, -1]
    if not used:
        return []
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    # Both cutoffs are relative to the largest singular value and free of n.
    largest = s.max(initial=0.0)
    rank = int((s > largest * len(used) * np.finfo(float).eps).sum())
    free = n - rank
    solved = int((s > largest * COEFFICIENT_CUTOFF).sum())
    u, s, vt = u[:, :solved], s[:solved], vt[:solved]
    beta = vt.T @ ((u.T @ y) / s)
    rows = []
    residual = y - x @ beta
    variance = float(residual @ residual) / free if free > 0 else math.nan
    spread = np.sqrt(np.sum((vt.T / s) ** 2, axis=1) * variance) if free > 0 else None
    for i, name in enumerate(names):
        if free <= 0:
            rows.append((name, None, None, n, free, rank))
            continue
        p = student_p_value(beta[i] / spread[i], free) if spread[i] > 0 else None
        rows.append((name, float(beta[i]), p, n, free, rank))
    return rows


def fit_grouped(design: DataFrame, factors, target: str, by: str) -> DataFrame:
    """Least squares without intercept per group, from a masked design.

    Columns: factor, beta, pvalue, n_obs, df_resid, rank.  With no residual
    degrees of freedom beta and pvalue are NULL; a rank below the number of
    factors marks a collinear design, solved with the shortest coefficients.
    """
    factors = list(factors)
    columns = [*factors, target]
    width = len(columns)
    kind = design.schema[by].dataType.simpleString()

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        n, factor = _stack(rows, width)
        used = [i for i in range(len(factors)) if np.any(factor[:, i] != 0.0)]
        solved = _solve(n, factor, used, [factors[i] for i in used])
        out = pd.DataFrame(solved, columns=["factor", "beta", "pvalue", "n_obs",
                                            "df_resid", "rank"])
        out.insert(0, by, rows[by].iloc[0])
        return out

    return partial_factors(design, columns, by).groupBy(by).applyInPandas(
        solve, f"`{by}` {kind}, factor string, beta double, pvalue double, "
               "n_obs bigint, df_resid bigint, rank bigint")


def ols_grouped(scored: DataFrame, factors, target: str, by: str = "country",
                null_limit: float = 0.2, kept: DataFrame | None = None) -> DataFrame:
    """Drop mostly-missing factors per group, then complete cases, then the fit."""
    if kept is None:
        kept = kept_factors(null_ratios(scored, factors, (by,)), (by,), null_limit)
    return fit_grouped(masked_design(scored, factors, target, by, kept), factors, target, by)
