"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division that is NULL for a zero denominator."""
    return F.try_divide(col(numerator), col(denominator))


def simple_return(later: Column | str, earlier: Column | str) -> Column:
    return ratio(col(later) - col(earlier), earlier)


def split_adjusted_price(price: Column | str, factor: Column | str) -> Column:
    return ratio(price, factor)


def split_adjusted_volume(volume: Column | str, factor: Column | str) -> Column:
    return col(volume) * col(factor)


def capitalization(price: Column | str, listed: Column | str) -> Column:
    return col(price) * col(listed)


def month_number(date: Column | str) -> Column:
    """Months since year 0, so that calendar offsets become integer offsets."""
    return F.year(date) * 12 + F.month(date) - 1


def month_start(date: Column | str) -> Column:
    return F.trunc(col(date), "MM")


def shift_months(date: Column | str, months: int) -> Column:
    return F.add_months(col(date), months)


def reporting_year(fiscal_year: Column | str, lag_years: int = 2) -> Column:
    """Year in which a statement is assumed to be known to investors."""
    return col(fiscal_year) + F.lit(lag_years)


def normalized_name(name: Column | str) -> Column:
    """Letters and digits only, lower case, for matching country names."""
    return F.lower(F.regexp_replace(col(name), "[^A-Za-z0-9]", ""))


def line_value(slope: Column | str, intercept: Column | str, x: Column | str) -> Column:
    return col(slope) * col(x) + col(intercept)


def bucket(value: Column | str, cuts, labels, missing=None) -> Column:
    """Label of the half-open bin ``[cut, next cut)`` that holds ``value``.

    ``labels`` has one more entry than ``cuts``.  A NULL value gets ``missing``.
    """
    if len(labels) != len(cuts) + 1:
        raise ValueError("need one label more than cut points")
    value = col(value)
    chain = F.when(value.isNull(), F.lit(missing).cast("string"))
    for cut, label in reversed(list(zip(cuts, labels[1:]))):
        chain = chain.when(value >= F.lit(float(cut)), F.lit(label))
    return chain.otherwise(F.lit(labels[0]))
