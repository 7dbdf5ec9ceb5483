"""Exact 64-bit integer arithmetic on columns (``/`` would go through double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(value: Column, divisor: int) -> Column:
    wide = value.cast("bigint")
    if divisor & (divisor - 1) == 0:
        return F.shiftright(wide, divisor.bit_length() - 1)
    d = F.lit(divisor).cast("bigint")
    return F.call_function("div", wide - F.pmod(wide, d), d)


def ceil_div(value: Column, divisor: int) -> Column:
    return floor_div(value.cast("bigint") + (divisor - 1), divisor)
