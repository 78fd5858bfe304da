"""Labels: distance in the upper half of a long, facility number in the lower.

Comparing labels compares distances, then facility numbers, and their minimum is a plain hash
aggregation.  Distances stay below 2**31.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 1 << 32
#: What dumps write for an origin that no facility reaches (fixed value).
UNREACHED = 4294967295


def pack(distance: Column, facility: Column) -> Column:
    return F.shiftleft(distance.cast("long"), 32).bitwiseOR(facility.cast("long"))


def distance(label: Column) -> Column:
    return F.shiftright(label, 32)


def facility(label: Column) -> Column:
    return label.bitwiseAND(F.lit(UNREACHED))
