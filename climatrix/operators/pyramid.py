"""Zoomed views: a pyramid of grid cells in Morton order.

Level z cuts a fixed extent into 2**z x 2**z cells. A cell's Morton number interleaves the bits of its x
and y, so the four cells below a cell share its number as a prefix: a level is the next finer one with
``cell >> 2``, and counts, sums and extremes merge. ``build`` reduces the points to the finest cells in one aggregate
and all levels from those; the table is partitioned by level and sorted by cell, so a view reads the
few ranges of cells that cover its window: Spark prunes the level's folder and skips row groups by their
statistics. A view at any level equals binning the points themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climatrix.functions.safe import finite, nan_to_null
from climatrix.operators.keys import station_key

#: (x0, x1, y0, y1) of the world in degrees.
WORLD = (-180.0, 180.0, -90.0, 90.0)
#: Finest level: 4096 x 4096 cells.
DEPTH = 12
#: Ranges of cells that a view's window is covered with; more would fit the window closer.
MAX_RANGES = 32

# Masks of the bit spreading for numbers below 2**32.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(c: Column) -> Column:
    """The bits of a number below 2**32 at the even places."""
    out = c.cast("bigint")
    for shift, mask in _SPREAD:
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return out


def _gathered(c: Column) -> Column:
    """The bits at even places, side by side again."""
    out = c.bitwiseAND(F.lit(_SPREAD[-1][1]).cast("bigint"))
    for (shift, _), (_, mask) in zip(reversed(_SPREAD), [*reversed(_SPREAD[:-1]), (0, 0x00000000FFFFFFFF)], strict=True):
        out = out.bitwiseOR(F.shiftright(out, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return out


def morton(x: Column, y: Column) -> Column:
    """Cell number from its column and row."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def cell_index(v: Column, lo: float, hi: float, level: int) -> Column:
    """Column or row of a coordinate; the last cell is closed, what lies outside of the extent has none."""
    raw = F.floor((v - lo) / (hi - lo) * float(1 << level))
    return F.when((v >= lo) & (v <= hi), F.least(raw, F.lit((1 << level) - 1)))


def _merged() -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("n_value").alias("n_value"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")]


def cells(points: DataFrame, x: str, y: str, value: str, extent: Sequence[float] = WORLD, depth: int = DEPTH, by: Sequence[str] = ()) -> DataFrame:
    """by..., cell, n (points), n_value, total, low, high (of the values) for the occupied finest cells."""
    x0, x1, y0, y1 = extent
    pts = points.select(*by, finite(F.col(x).cast("double")).alias("_x"), finite(F.col(y).cast("double")).alias("_y"), nan_to_null(F.col(value).cast("double")).alias("_v"))
    pts = pts.withColumns({"_i": cell_index(F.col("_x"), x0, x1, depth), "_j": cell_index(F.col("_y"), y0, y1, depth)}).dropna(subset=["_i", "_j"])
    return pts.groupBy(*by, morton(F.col("_i"), F.col("_j")).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.count("_v").alias("n_value"), F.sum("_v").alias("total"), F.min("_v").alias("low"), F.max("_v").alias("high")
    )


def station_cells(
    df: DataFrame, stations: DataFrame, value: str = "tavg", extent: Sequence[float] = WORLD, depth: int = DEPTH, by: Sequence[str] = ("year",)
) -> DataFrame:
    """``cells`` of observations by their stations' lon and lat: reduced per station first, so no fact row is joined."""
    x0, x1, y0, y1 = extent
    k = station_key(df, stations)
    v = nan_to_null(F.col(value).cast("double"))
    per = df.dropna(subset=[k]).groupBy(*by, k).agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("n_value"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high")
    )
    pts = per.join(stations.select(k, finite(F.col("lon")).alias("_x"), finite(F.col("lat")).alias("_y")), k)
    pts = pts.withColumns({"_i": cell_index(F.col("_x"), x0, x1, depth), "_j": cell_index(F.col("_y"), y0, y1, depth)}).dropna(subset=["_i", "_j"])
    return pts.groupBy(*by, morton(F.col("_i"), F.col("_j")).alias("cell")).agg(*_merged())


def build(finest: DataFrame, path: str, depth: int = DEPTH, by: Sequence[str] = ()) -> DataFrame:
    """Write all levels of ``cells`` below ``path``, partitioned by level and sorted by cell; the table read back.

    Each finest cell goes to every level and is summed in the task that holds it before the shuffle.
    """
    up = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    up = up.withColumn("cell", F.call_function("shiftright", F.col("cell"), 2 * (depth - F.col("level"))))
    levels = up.groupBy("level", *by, "cell").agg(*_merged())
    levels.repartitionByRange("level", "cell").sortWithinPartitions("level", "cell").write.mode("overwrite").partitionBy("level").parquet(path)
    return finest.sparkSession.read.parquet(path)


def window_ranges(i0: int, i1: int, j0: int, j1: int, level: int, most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges of cell numbers that cover the columns i0..i1 and rows j0..j1 of a level.

    The quarters of the extent are divided, largest first, while they straddle the window's border and
    ranges are left.
    """
    todo, out = [(level, 0)], []
    while todo:
        todo.sort()
        bits, cell = todo.pop()  # the largest undivided square
        i, j = _column(cell) << bits, _column(cell >> 1) << bits
        size = 1 << bits
        if i > i1 or j > j1 or i + size <= i0 or j + size <= j0:
            continue
        inside = i >= i0 and j >= j0 and i + size - 1 <= i1 and j + size - 1 <= j1
        if inside or bits == 0 or len(out) + len(todo) + 4 > most:
            out.append((cell << 2 * bits, ((cell + 1) << 2 * bits) - 1))
        else:
            todo += [(bits - 1, 4 * cell + q) for q in range(4)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a == merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def _column(cell: int) -> int:
    return sum((cell >> 2 * b & 1) << b for b in range(32))


def view(table: DataFrame, window: Sequence[float], level: int, extent: Sequence[float] = WORLD, by: Sequence[str] = ()) -> DataFrame:
    """by..., x_bin, y_bin, n, mean, low, high of the occupied cells of ``level`` that touch the window (x0, x1, y0, y1).

    Only the level's folder and the row groups that hold the covering ranges are read. Filters on ``by``
    columns (years) are put on ``table`` before the call; without ``by`` these are summed up.
    """
    x0, x1, y0, y1 = extent
    top = (1 << level) - 1

    def at(v: float, lo: float, hi: float) -> int:
        return min(max(int((v - lo) / (hi - lo) * (1 << level) // 1), 0), top)

    wx0, wx1, wy0, wy1 = window
    i0, i1, j0, j1 = at(wx0, x0, x1), at(wx1, x0, x1), at(wy0, y0, y1), at(wy1, y0, y1)
    near = F.lit(False)
    for a, b in window_ranges(i0, i1, j0, j1, level):
        near = near | F.col("cell").between(F.lit(a).cast("bigint"), F.lit(b).cast("bigint"))
    rows = table.where((F.col("level") == level) & near)
    rows = rows.withColumns({"x_bin": _gathered(F.col("cell")).cast("int"), "y_bin": _gathered(F.shiftright("cell", 1)).cast("int")})
    rows = rows.where(F.col("x_bin").between(i0, i1) & F.col("y_bin").between(j0, j1))
    out = rows.groupBy(*by, "x_bin", "y_bin").agg(*_merged())
    return out.select(*by, "x_bin", "y_bin", "n", F.try_divide("total", "n_value").alias("mean"), "low", "high")
