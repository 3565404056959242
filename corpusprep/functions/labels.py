"""Human-readable labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FRACTION_BITS = 52


def _one_decimal(value: Column) -> Column:
    """`value` (a double of at least 1) with one decimal, trailing zero cut.

    Rounds the exact binary value, ties to even, as C's ``%.1f`` does. The
    fraction of a double above 1 is a whole number of 2^-52, so the rounding is
    done on integers.
    """
    whole = F.floor(value)
    fraction = ((value - whole) * float(2**_FRACTION_BITS)).cast("bigint")
    scaled = fraction * 10
    tenth = F.shiftright(scaled, _FRACTION_BITS)
    rest = scaled - F.shiftleft(tenth, _FRACTION_BITS)
    half = F.lit(2 ** (_FRACTION_BITS - 1)).cast("bigint")
    up = (rest > half) | ((rest == half) & (F.pmod(tenth, F.lit(2)) == 1))
    tenths = whole * 10 + tenth + up.cast("bigint")
    units = F.floor(tenths / 10).cast("string")
    digit = F.pmod(tenths, F.lit(10))
    return F.when(digit == 0, units).otherwise(F.concat(units, F.lit("."), digit.cast("string")))


def size_label(count: Column) -> Column:
    """1234567 -> ``1.2M``. The unit is chosen before rounding, so 999950 gives ``1000K``."""
    count = count.cast("bigint")

    def scaled(divisor: float, unit: str) -> Column:
        return F.concat(_one_decimal(count.cast("double") / divisor), F.lit(unit))

    return (
        F.when(count >= 1_000_000_000, scaled(1e9, "B"))
        .when(count >= 1_000_000, scaled(1e6, "M"))
        .when(count >= 1_000, scaled(1e3, "K"))
        .otherwise(count.cast("string"))
    )
