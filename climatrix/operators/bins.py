"""Histograms, grids and per-group distributions.

The extent (min/max) is one global aggregate used as a scalar subquery: it
runs once and its single row is inlined into the binning expressions. The
binned aggregation is partial + final; its output is bounded by the number
of cells, never by the data. Only occupied cells are returned, except the
histogram, which lists every bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climatrix.functions.binning import bin_edge, bin_index, bin_lower, bin_upper, edge_bin
from climatrix.functions.calendar import epoch_micros
from climatrix.functions.safe import finite, nan_to_null
from climatrix.operators.keys import station_key
from climatrix.operators.quantile import exact_quantiles, met, values_of
from climatrix.schema import GRID_MAP, GRID_SCATTER, GRID_SPATIAL
from climatrix.session import materialize


def histogram(df: DataFrame, column: str = "tavg", bins: int = 100) -> DataFrame:
    """Equal-width counts over [min, max] as numpy bins them; the last bin is closed.

    Output ``(bin, lo, hi, n)`` for every bin (empty bins have n = 0). A value
    goes to the bin whose own edges hold it, so rounding at an edge can't
    move it. A constant column gets the range value -0.5 to +0.5. Infinite values are in no bin, so
    ``n`` sums to the finite ones (``infinite_values`` counts the others). Two passes over
    the column: the extent (a scalar subquery, run once), then the counts,
    joined to the list of all bins.
    """
    bins = int(bins)
    if bins < 1:
        raise ValueError(f"bins must be at least 1, got {bins}")
    v = df.select(finite(F.col(column).cast("double")).alias("_v")).dropna()
    ext = extent(v, ["_v"])
    flat = ext["_v_lo"] == ext["_v_hi"]
    lo = F.when(flat, ext["_v_lo"] - 0.5).otherwise(ext["_v_lo"])
    hi = F.when(flat, ext["_v_hi"] + 0.5).otherwise(ext["_v_hi"])
    counts = v.groupBy(edge_bin(F.col("_v"), lo, hi, bins).alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").filter(lo.isNotNull()).select(
        "bin",
        bin_edge(F.col("bin"), lo, hi, bins).alias("lo"),
        bin_edge(F.col("bin") + 1, lo, hi, bins).alias("hi"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"),
    )


def infinite_values(df: DataFrame, column: str = "tavg") -> DataFrame:
    """``(below, above)``: how many values of a column are -Infinity and Infinity, which no bin holds."""
    v = F.col(column).cast("double")
    return df.agg(F.count_if(v == float("-inf")).alias("below"), F.count_if(v == float("inf")).alias("above"))


def extent(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """Min and max of each column as one scalar subquery (a struct).

    Spark runs the subquery once and inlines its single row into the
    expressions that use it: no join with the rows is needed.
    """
    aggs = [F.min(c).alias(f"{c}_lo") for c in cols] + [F.max(c).alias(f"{c}_hi") for c in cols]
    one = df.agg(F.struct(*aggs).alias("_e")).select("_e").scalar()
    return {f"{c}_{end}": one.getField(f"{c}_{end}") for c in cols for end in ("lo", "hi")}


def _cells(df: DataFrame, x: str, y: str, width: int, height: int) -> DataFrame:
    e = extent(df, [x, y])
    return df.withColumns(
        {
            "x_bin": bin_index(F.col(x), e[f"{x}_lo"], e[f"{x}_hi"], width),
            "y_bin": bin_index(F.col(y), e[f"{y}_lo"], e[f"{y}_hi"], height),
        }
    )


def grid_xy(
    df: DataFrame,
    x: str = "tavg",
    y: str = "prcp",
    value: str | None = "year",
    width: int = GRID_SCATTER[0],
    height: int = GRID_SCATTER[1],
) -> DataFrame:
    """Any x, y on a width x height grid; mean of ``value`` per cell,
    or the point count when ``value`` is None. A text ``value`` gives the
    count per (cell, category). Points with an infinite x or y are in no cell."""
    cols = [x, y] + ([value] if value else [])
    pts = df.select(*[F.col(c) if not _is_double(df, c) else nan_to_null(F.col(c)) if c == value else finite(F.col(c)) for c in cols])
    pts = pts.toDF(*cols).dropna(subset=[x, y])
    cells = _cells(pts, x, y, width, height)
    if value is None:
        return cells.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))
    if isinstance(df.schema[value].dataType, T.StringType):
        return (
            cells.filter(F.col(value).isNotNull())
            .groupBy("x_bin", "y_bin", value)
            .agg(F.count(F.lit(1)).alias("n"))
        )
    return (
        cells.groupBy("x_bin", "y_bin")
        .agg(F.avg(value).alias(f"{value}_mean"))
        .filter(F.col(f"{value}_mean").isNotNull())
    )


def _is_double(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))


def grid_mean(
    df: DataFrame,
    stations: DataFrame | None = None,
    value: str = "tavg",
    width: int = GRID_SPATIAL[0],
    height: int = GRID_SPATIAL[1],
    extent_needs_value: bool = True,
) -> DataFrame:
    """Lon x lat grid of mean ``value`` (occupied cells only).

    ``extent_needs_value=True`` is the spatial heat map's form: rows with a
    null lat, lon or value are dropped before anything else. ``False`` is
    the map view's form: the extent comes from every point with
    coordinates, and the mean per cell skips null values.

    Given a separate station table, observations are reduced to one row per
    station (sum, count) before the join, and the extent and binning run on
    stations, not rows: the fact table is scanned once and never joined.
    """
    if stations is None or ("lat" in df.columns and "lon" in df.columns):
        pts = df.select(finite("lon").alias("lon"), finite("lat").alias("lat"), nan_to_null(F.col(value)).alias("_v")).dropna(subset=["lon", "lat"])
        if extent_needs_value:
            pts = pts.dropna(subset=["_v"])
        return (
            _cells(pts, "lon", "lat", width, height)
            .groupBy("x_bin", "y_bin")
            .agg(F.avg("_v").alias(f"{value}_mean"))
            .filter(F.col(f"{value}_mean").isNotNull())
        )
    k = station_key(df, stations)
    per = (
        df.select(k, nan_to_null(F.col(value)).alias("_v"))
        .dropna(subset=[k])
        .groupBy(k)
        .agg(F.sum("_v").alias("_s"), F.count("_v").alias("_c"))
    )
    if extent_needs_value:
        per = per.filter(F.col("_c") > 0)
    pts = per.join(stations.select(k, finite("lon").alias("lon"), finite("lat").alias("lat")), k).dropna(subset=["lon", "lat"])
    # One row per station feeds both the extent and the binning: write it
    # once so the fact table is scanned once.
    pts = materialize(pts)
    return (
        _cells(pts, "lon", "lat", width, height)
        .groupBy("x_bin", "y_bin")
        .agg(F.try_divide(F.sum("_s"), F.sum("_c")).alias(f"{value}_mean"))
        .filter(F.col(f"{value}_mean").isNotNull())
    )


def grid_map(df: DataFrame, stations: DataFrame | None = None, value: str = "tavg") -> DataFrame:
    """A22, map-view form: 800 x 600, extent over every located point
    (no sampling: exact binning over all rows)."""
    return grid_mean(df, stations, value, GRID_MAP[0], GRID_MAP[1], extent_needs_value=False)


def series_points(df: DataFrame, x: str = "date", y: str = "tavg") -> DataFrame:
    """The raw points (x, y) of a series, without the incomplete ones and infinite values."""
    return df.select(F.col(x), finite(F.col(y)).alias(y)).dropna()


def grid_series(
    df: DataFrame,
    x: str = "date",
    y: str = "tavg",
    width: int = GRID_SPATIAL[0],
    height: int = GRID_SPATIAL[1],
) -> DataFrame:
    """Date x value point counts on a 800 x 400 grid, for any number of rows."""
    xs = series_points(df, x, y).select(epoch_micros(F.col(x)).alias("_x"), F.col(y))
    return _cells(xs, "_x", y, width, height).groupBy("x_bin", "y_bin").agg(
        F.count(F.lit(1)).alias("n")
    )


def density_2d(
    df: DataFrame, x: str = "tavg", y: str = "humidity", nbins_x: int = 20, nbins_y: int = 20
) -> DataFrame:
    """2-D histogram counts of two columns over their extent; points with an infinite one are left out."""
    pts = df.select(finite(F.col(x)).alias(x), finite(F.col(y)).alias(y)).dropna()
    return _cells(pts, x, y, nbins_x, nbins_y).groupBy("x_bin", "y_bin").agg(
        F.count(F.lit(1)).alias("n")
    )


def box_stats(df: DataFrame, value: str = "value", by: Sequence[str] = ("event_type",)) -> DataFrame:
    """Per group quartiles (linear), 1.5 IQR fences, whiskers (most
    extreme values inside the fences) and the outlier count.

    Quartiles come from counting passes; the fences, a row per group, then
    meet the values in one more aggregate. Neither moves a row.
    """
    by = list(by)
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], by, ["q1", "median", "q3"])
    q = materialize(q.withColumns(
        {
            "lower_fence": F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1")),
            "upper_fence": F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1")),
        }
    ))
    v, lf, uf = F.col("_v"), F.col("lower_fence"), F.col("upper_fence")
    fences = q.select(*by, "lower_fence", "upper_fence")
    edges = met(values_of(df, value, by), fences, by, q.count()).groupBy(*by).agg(
        F.min(F.when(v >= lf, v)).alias("whisker_low"),
        F.max(F.when(v <= uf, v)).alias("whisker_high"),
        F.count_if((v < lf) | (v > uf)).alias("outliers"),
    )
    return q.join(edges, by).select(
        *by, "n", "q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low", "whisker_high", "outliers"
    )


def violin_density(
    df: DataFrame,
    value: str = "tavg",
    by: str | Sequence[str] = "continent",
    bins: int = 50,
    stations: DataFrame | None = None,
) -> DataFrame:
    """Per group (one key, or two: x and colour), binned relative density (bin count / group count) over
    bins shared by all groups. Binned, not kernel-smoothed.

    When the group is a station attribute held in ``stations``, rows are
    counted per (station, bin) first and only that table is joined.
    """
    bins = int(bins)
    by = [by] if isinstance(by, str) else list(by)
    far = [c for c in by if c not in df.columns] if stations is not None else []  # held by the station table
    key = [c for c in by if c not in far] + ([station_key(df, stations)] if far else [])
    pts = df.select(*key, finite(F.col(value).cast("double")).alias("_v")).dropna()
    ext = extent(pts, ["_v"])
    lo, hi = ext["_v_lo"], ext["_v_hi"]
    cnt = pts.groupBy(*key, bin_index(F.col("_v"), lo, hi, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    if far:
        cnt = (
            cnt.join(stations.select(key[-1], *far), key[-1])
            .dropna(subset=far)
            .groupBy(*by, "bin")
            .agg(F.sum("_n").alias("_n"))
        )
    # Group totals: a window per group over the counts (at most ``bins`` rows
    # per group), so the counts are computed once.
    cnt = cnt.withColumn("_t", F.sum("_n").over(Window.partitionBy(*by)))
    return cnt.select(
        *by,
        F.col("bin").cast("int").alias("bin"),
        bin_lower(F.col("bin"), lo, hi, bins).alias("lo"),
        bin_upper(F.col("bin"), lo, hi, bins).alias("hi"),
        (F.col("_n") / F.col("_t")).alias("density"),
    )


#: Grid points of a smoothed violin, and how many bandwidths it goes on beyond the extremes.
VIOLIN_POINTS = 128
VIOLIN_CUT = 4.0
#: Silverman's factor for a Gaussian kernel.
SILVERMAN = (4.0 / 3.0) ** 0.2


def violin_kernel(
    df: DataFrame, value: str = "tavg", by: str | Sequence[str] = "continent", points: int = VIOLIN_POINTS, stations: DataFrame | None = None
) -> DataFrame:
    """A27, smoothed: ``(by..., point, x, density, bandwidth, n)``, a Gaussian kernel estimate on a grid of each group's own.

    1. One aggregate gives every group's count, deviation and range, and so its bandwidth (Silverman's rule
       on the standard deviation) and a grid that goes ``VIOLIN_CUT`` bandwidths beyond its extremes.
    2. A second one shares each value between the two grid points around it (linear binning): at most ``points``
       weights a group, whatever the number of rows, summed in the tasks first.
    3. The weights are convolved with the kernel, group by group, and scaled so that the density sums to 1 over the grid.

    Groups with fewer than two different finite values have no rows. With a group attribute
    held in ``stations``, rows are first reduced per station; the grid reaches the rows by their station.
    """
    by = [by] if isinstance(by, str) else list(by)
    points = int(points)
    far = [c for c in by if c not in df.columns] if stations is not None else []
    own = [c for c in by if c not in far]
    key = own + ([station_key(df, stations)] if far else [])
    pts = df.select(*key, finite(F.col(value).cast("double")).alias("_v")).dropna()
    per = pts.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("m"), (F.var_pop("_v") * F.count("_v")).alias("m2"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    places = stations.select(key[-1], *far).dropna() if far else None
    if far:
        per = per.join(places, key[-1])
    group = Window.partitionBy(*by)  # a row a station, or a row a group
    mean = F.sum(F.col("m") * F.col("n")).over(group) / F.sum("n").over(group)
    per = per.withColumn("m2", F.col("m2") + F.col("n") * (F.col("m") - mean) * (F.col("m") - mean))
    grid = per.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("m2").alias("m2"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    bw = F.lit(SILVERMAN) * F.sqrt(F.col("m2") / (F.col("n") - 1)) * F.pow(F.col("n"), F.lit(-0.2))
    grid = grid.withColumn("bandwidth", bw).withColumn("start", F.col("lo") - VIOLIN_CUT * F.col("bandwidth"))
    grid = materialize(grid.withColumn("step", (F.col("hi") + VIOLIN_CUT * F.col("bandwidth") - F.col("start")) / (points - 1)).select(*by, "n", "bandwidth", "start", "step"))

    if far:
        pts = pts.join(places.join(grid.select(*by, "start", "step"), far), [key[-1], *own]) if own else pts.join(places.join(grid, far).select(key[-1], *far, "start", "step"), key[-1])
    else:
        pts = met(pts, grid.select(*by, "start", "step"), by, grid.count())
    at = (F.col("_v") - F.col("start")) / F.col("step")
    low = F.least(F.floor(at), F.lit(points - 2))
    split = F.explode(F.array(F.struct(low.alias("j"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("j"), (at - low).alias("w"))))
    weights = pts.select(*by, split.alias("x")).groupBy(*by, "x.j").agg(F.sum("x.w").alias("w"))
    held = weights.groupBy(*by).agg(F.collect_list(F.struct("j", "w")).alias("ws")).join(grid, by)

    def smoothed(k: Column) -> Column:
        u = F.col("step") / F.col("bandwidth")
        return F.aggregate("ws", F.lit(0.0), lambda a, x: a + x["w"] * F.exp(-0.5 * F.pow((k - x["j"]) * u, F.lit(2.0))))

    curve = held.withColumn("d", F.transform(F.sequence(F.lit(0), F.lit(points - 1)), smoothed))
    curve = curve.withColumn("area", F.aggregate("d", F.lit(0.0), lambda a, x: a + x) * F.col("step"))
    rows = curve.select(*by, "n", "bandwidth", "start", "step", "area", F.posexplode("d").alias("point", "d"))
    return rows.select(*by, "point", (F.col("start") + F.col("point") * F.col("step")).alias("x"), (F.col("d") / F.col("area")).alias("density"), "bandwidth", "n")
