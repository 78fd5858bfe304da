"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimals(x: Column, digits: int) -> Column:
    """A number of at least 0 and below 2**43 with up to three digits after the point, by its exact binary value, half to even.

    Java rounds the shortest decimal form of a double instead, which differs where that ends in 5.
    The part after the point times 2**52 is a whole number; a thousand times that fits a long.
    """
    factor = 10**digits
    whole = F.floor(x)
    scaled = (x - whole) * F.lit(float(1 << 52))
    units = F.floor(scaled)
    # numbers below 1 have digits beyond those units
    beyond = (scaled - units) * factor
    extra = F.floor(beyond)
    product = units * factor + extra
    down = F.shiftright(product, 52)
    rest = product - F.shiftleft(down, 52)
    half = F.lit(1 << 51)
    total = whole * factor + down
    more = (rest > half) | ((rest == half) & ((beyond > extra) | (total % 2 == 1)))
    total = total + F.when(more, 1).otherwise(0)
    if not digits:
        return F.format_string("%d", total)
    return F.format_string(f"%d.%0{digits}d", F.floor(total / factor), total % factor)


def three_decimals(x: Column) -> Column:
    return decimals(x, 3)
