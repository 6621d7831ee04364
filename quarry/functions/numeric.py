"""Numeric helpers that reproduce the reference's NumPy/Python arithmetic exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def np_round(col: Column | str, digits: int) -> Column:
    """NumPy ``round(x, d)``: scale, round half to even on the binary value, unscale.

    Spark's ``bround`` rounds the *decimal string* of the double, which differs from
    NumPy on values such as 12.355; ``rint`` on the scaled double does not.
    """
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def pct(part: Column | str, whole: Column | str) -> Column:
    """``(part / whole) * 100`` in double, in the reference's operation order."""
    p = F.col(part) if isinstance(part, str) else part
    w = F.col(whole) if isinstance(whole, str) else whole
    return (p.cast("double") / w.cast("double")) * F.lit(100.0)


def trunc_int(col: Column | str) -> Column:
    """Python ``int(x)`` for non-negative doubles (truncation), as BIGINT."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c).cast("bigint")
