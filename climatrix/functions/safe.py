"""ANSI-safe arithmetic and statistics expressions.

ANSI mode (on by default) raises on division by zero, including inside
``corr``; pandas gives NaN. Every divisor that can be 0 goes through
``try_divide`` so the result is null instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6  # registered outputs round doubles to this many decimals


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """pandas skips NaN; Spark propagates it. Turn NaN into null on ingest."""
    c = col_of(c)
    return F.when(~F.isnan(c), c)


def finite(c: Column | str) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = col_of(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def nan_free(df: DataFrame) -> DataFrame:
    """``df`` with NaN as null in its double and float columns, as pandas skips both.

    SQL text keeps plan building cheap; unused columns are pruned away again.
    """
    kinds = (T.DoubleType, T.FloatType)
    if not any(isinstance(f.dataType, kinds) for f in df.schema.fields):
        return df
    return df.selectExpr(
        *(f"IF(isnan(`{f.name}`), NULL, `{f.name}`) AS `{f.name}`" if isinstance(f.dataType, kinds) else f"`{f.name}`" for f in df.schema.fields)
    )


# Fixed value: the number formats that count as numeric text.
NUMBER = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def to_number(c: Column | str) -> Column:
    """Numeric text as double, other text (suffixed like ``12d``, ``NaN``) as null."""
    c = col_of(c)
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def pair_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson r over pairwise-complete rows; null where a column is constant.

    covar_samp already skips rows where either side is null; the standard
    deviations are restricted to the same rows.
    """
    a, b = col_of(a), col_of(b)
    both = a.isNotNull() & b.isNotNull()
    sa = F.stddev_samp(F.when(both, a))
    sb = F.stddev_samp(F.when(both, b))
    return F.try_divide(F.covar_samp(a, b), sa * sb)


def share_pct(cond: Column) -> Column:
    """Percentage of all rows (nulls included in the denominator) meeting cond."""
    return F.try_divide(F.count_if(cond) * F.lit(100.0), F.count(F.lit(1)))


def sum0(c: Column | str) -> Column:
    """pandas sum: an all-null group sums to 0, not null."""
    return F.coalesce(F.sum(col_of(c)), F.lit(0.0))
