"""Equal-width binning expressions shared by histograms and grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_index(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Bin of ``v`` among ``n`` equal bins over [lo, hi]; the last bin is closed.

    When lo = hi every value goes to bin 0. Null in, null out.
    """
    raw = F.floor((v - lo) / (hi - lo) * F.lit(n))
    return F.when(v.isNull(), F.lit(None).cast("int")).when(
        hi > lo, F.least(raw, F.lit(n - 1)).cast("int")
    ).otherwise(F.lit(0))


def bin_lower(b: Column, lo: Column, hi: Column, n: int) -> Column:
    return lo + b * (hi - lo) / F.lit(float(n))


def bin_upper(b: Column, lo: Column, hi: Column, n: int) -> Column:
    return lo + (b + F.lit(1)) * (hi - lo) / F.lit(float(n))


def bin_edge(b: Column, lo: Column, hi: Column, n: int) -> Column:
    """Edge ``b`` of ``n`` equal bins, computed as start + step * b; the last one is ``hi`` itself."""
    return F.when(b == n, hi).otherwise(b * ((hi - lo) / F.lit(float(n))) + lo)


def edge_bin(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Bin of ``v`` by the edges themselves: the rounded quotient moves down or up by one where an edge says so."""
    raw = F.least(F.floor((v - lo) / (hi - lo) * F.lit(n)), F.lit(n - 1))
    down = F.when(v < bin_edge(raw, lo, hi, n), raw - 1).otherwise(raw)
    return F.when((v >= bin_edge(down + 1, lo, hi, n)) & (down != n - 1), down + 1).otherwise(down).cast("int")
