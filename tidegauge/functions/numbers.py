"""Numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for a missing number; sizes with their unit and digits, largest first.
MISSING, UNITS = "—", ((1e9, "B", 2), (1e6, "M", 2), (1e3, "K", 1))


def plain(name: str, digits: int = 2) -> Column:
    """With so many digits."""
    return F.when(F.col(name).isNull(), MISSING).otherwise(F.format_string(f"%.{digits}f", F.col(name).cast("double")))


def percent(name: str) -> Column:
    return F.when(F.col(name).isNull(), MISSING).otherwise(F.format_string("%.2f%%", F.col(name).cast("double") * 100))


def big(name: str) -> Column:
    """In billions, millions or thousands by its size, whatever its sign."""
    n = F.col(name).cast("double")
    out = F.when(n.isNull(), MISSING)
    for size, unit, digits in UNITS:
        out = out.when(F.abs(n) >= size, F.format_string(f"%.{digits}f{unit}", n / size))
    return out.otherwise(F.format_string("%.0f", n))
