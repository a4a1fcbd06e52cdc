"""An order of several columns as one fixed-width value.

The first value of a group in an order is ``min_by(value, order)``.  With a struct as
order Spark sorts all rows to aggregate them, because a struct does not fit into the
fixed-width buffer of a hash aggregate.  A ``PackedOrder`` states how many bits each
column takes; up to 63 bits become a long and up to 126 a decimal, which both fit, and
which compare like the columns one after the other, NULL first.

The widths are a promise about the data: a value outside of its width, or one that is
no multiple of its unit, ends the query with an error rather than with a wrong order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANE = 63


class Field(NamedTuple):
    """``name`` takes values from ``low`` on in ``bits`` bits, counted in units of 1/``per_unit``."""

    name: str
    bits: int
    per_unit: int = 1
    low: int = 0


def date_field(name: str, bits: int = 24) -> Field:
    """A date; 24 bits reach from about 21,000 BC to AD 25,000."""
    return Field(name, bits, low=-(1 << (bits - 1)))


class PackedOrder(tuple):
    """A tuple of column names that knows the width of each."""

    fields: tuple[Field, ...]

    def __new__(cls, *fields: Field):
        order = super().__new__(cls, [f.name for f in fields])
        order.fields = tuple(fields)
        lanes = order.lanes()
        if len(lanes) > 2:
            raise ValueError(f"the order takes {sum(f.bits for f in fields)} bits; two lanes of {LANE} are the most")
        return order

    def lanes(self) -> list[list[Field]]:
        """The fields in as few groups of at most 63 bits as their sequence allows."""
        lanes: list[list[Field]] = []
        for field in self.fields:
            if not 1 <= field.bits <= LANE:
                raise ValueError(f"{field.name} takes {field.bits} bits")
            if lanes and sum(f.bits for f in lanes[-1]) + field.bits <= LANE:
                lanes[-1].append(field)
            else:
                lanes.append([field])
        return lanes

    def key(self, df: DataFrame) -> Column:
        kinds = dict(df.dtypes)
        packed = []
        for lane in self.lanes():
            value = F.lit(0).cast("long")
            for field in lane:
                value = F.shiftleft(value, field.bits).bitwiseOR(_placed(field, kinds[field.name]))
            packed.append((value, sum(f.bits for f in lane)))
        if len(packed) == 1:
            return packed[0][0]
        (high, _), (low, bits) = packed
        return (high.cast("decimal(20,0)") * F.lit(str(1 << bits)).cast("decimal(20,0)")).cast("decimal(38,0)") \
            + low.cast("decimal(20,0)")


def _placed(field: Field, kind: str) -> Column:
    """The number of a value within its width, from 1 on; 0 is NULL."""
    column = F.col(field.name)
    if kind == "date":
        number = F.unix_date(column).cast("long")
    elif field.per_unit == 1 and kind in ("tinyint", "smallint", "int", "bigint"):
        number = column.cast("long")
    else:
        units = column.cast("double") * field.per_unit
        number = F.when(F.abs(units - F.round(units)) > 1e-4, F.raise_error(F.lit(
            f"{field.name} is no multiple of 1/{field.per_unit}"))).otherwise(F.round(units)).cast("long")
    place = number - F.lit(field.low) + F.lit(1)
    fits = place.between(1, (1 << field.bits) - 1)
    return F.when(column.isNull(), F.lit(0).cast("long")).when(fits, place).otherwise(
        F.raise_error(F.lit(f"{field.name} does not fit into {field.bits} bits")).cast("long"))
