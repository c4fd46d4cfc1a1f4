"""Descriptive statistics, correlations and linear trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climatrix.functions.safe import nan_to_null, pair_corr
from climatrix.operators.quantile import SKETCH_K, exact_quantiles, quantiles_from_stats, values_of
from climatrix.session import materialize


def describe(df: DataFrame, cols: Sequence[str] | None = None, method: str = "exact") -> DataFrame:
    """Count, mean, std, min, 25/50/75 %, max for each column (by default every numeric one).

    Moments, extremes and a sketch of each column are one partial + final aggregate; quartiles are
    exact (counting passes over the stacked columns, the first one around the sketch's quartiles) or, with
    ``method='approx'``, sketched. Output: one row per column, also for columns without values.
    (``DataFrame.summary`` is not used: its quartiles are approximate.)
    """
    cols = list(cols) if cols is not None else numeric_column_names(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double")
    long = df.select(
        F.stack(
            F.lit(len(cols)), *[x for i, c in enumerate(cols) for x in (F.lit(i), nan_to_null(F.col(c).cast("double")))]
        ).alias("_col", "value")
    )
    m = long.groupBy("_col").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        *([F.call_function("kll_sketch_agg_double", F.col("value"), F.lit(SKETCH_K)).alias("_sketch")] if method == "exact" else []),
    )
    probs, names = [0.25, 0.5, 0.75], ["p25", "p50", "p75"]
    if method == "exact":  # the moments already hold the counts and extremes that the passes start from
        m = materialize(m)
        known = m.filter("count > 0").select("_col", F.col("count").alias("n"), F.col("min").alias("_lo"), F.col("max").alias("_hi"), "_sketch")
        q = quantiles_from_stats(values_of(long, "value", ["_col"]), known, probs, ["_col"], names).select("_col", *names)
    else:
        q = exact_quantiles(long, "value", probs, by=["_col"], names=names, method=method).drop("n")
    present = df.sparkSession.createDataFrame(list(enumerate(cols)), "_col int, column string")
    # Every table here has one row per requested column: broadcasts are bounded.
    return present.join(F.broadcast(m), "_col", "left").join(F.broadcast(q), "_col", "left").select(
        "column",
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
        "mean", "std", "min", "p25", "p50", "p75", "max",
    )


def numeric_column_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


#: Of a pair of columns: complete rows, means and what rounding took from them, sums of squares and of products about the means.
_MOMENTS = ("n", "mi", "mj", "li", "lj", "qi", "qj", "c")


def _merged(a, b):
    """Co-moments of the union of two sets of rows, from theirs (arrays of ``_MOMENTS``)."""
    import numpy as np

    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    both, old = a[0] * share, a[0] > 0
    # Differences of means of like size are exact; the merged mean stays beside the first one.
    di, dj = (b[1] - a[1]) + (b[3] - a[3]), (b[2] - a[2]) + (b[4] - a[4])
    means = [np.where(old, a[k], b[k]) for k in (1, 2)] + [np.where(old, a[k] + d * share, b[k]) for k, d in ((3, di), (4, dj))]
    di, dj = np.where(old, di, 0.0), np.where(old, dj, 0.0)
    return np.stack([n, *means, a[5] + b[5] + di * di * both, a[6] + b[6] + dj * dj * both, a[7] + b[7] + di * dj * both])


def _batch_moments(x):
    """Co-moments of every column pair (i <= j) over the rows of a batch that have both values."""
    import numpy as np

    iu, ju = np.triu_indices(x.shape[1])
    present = ~np.isnan(x)
    full = present.all(axis=0)
    out = np.zeros((len(_MOMENTS), len(iu)))
    if full.any():  # columns without gaps share their rows: one product gives all of their pairs
        d = x[:, full]
        mean = d.mean(axis=0)
        d = d - mean
        low = d.mean(axis=0)
        d -= low
        cross, at = d.T @ d, np.cumsum(full) - 1
        pair = full[iu] & full[ju]
        i, j = at[iu[pair]], at[ju[pair]]
        out[:, pair] = np.stack([np.full(len(i), len(x), dtype=float), mean[i], mean[j], low[i], low[j], cross[i, i], cross[j, j], cross[i, j]])
    for k in np.flatnonzero(~(full[iu] & full[ju])):
        rows = present[:, iu[k]] & present[:, ju[k]]
        if rows.any():
            a, b = x[rows, iu[k]], x[rows, ju[k]]
            p, q = a - a.mean(), b - b.mean()
            li, lj = p.mean(), q.mean()
            out[:, k] = rows.sum(), a.mean(), b.mean(), li, lj, (p - li) @ (p - li), (q - lj) @ (q - lj), (p - li) @ (q - lj)
    return out


def _partition_moments(cols: list[str]):
    """Per task: the co-moments and extremes of every column pair, one row a pair; memory is O(k^2) besides the Arrow batch."""
    import numpy as np
    import pandas as pd

    k = len(cols)
    iu, ju = np.triu_indices(k)

    def run(batches):
        total = np.zeros((len(_MOMENTS), len(iu)))
        lo, hi = np.full((2, len(iu)), np.inf), np.full((2, len(iu)), -np.inf)
        with np.errstate(all="ignore"):  # infinite values make a pair's r null
            for pdf in batches:
                x = pdf[cols].to_numpy(dtype="float64", na_value=np.nan)
                if not len(x):
                    continue
                total = _merged(total, _batch_moments(x))
                present = ~np.isnan(x)
                for j in range(k):  # extremes of every column on the rows where column j has a value
                    if present[:, j].any():
                        own = x if present[:, j].all() else x[present[:, j]]
                        low, high = np.fmin.reduce(own, axis=0), np.fmax.reduce(own, axis=0)
                        for side, (mine, other) in enumerate(((iu, ju), (ju, iu))):
                            at = other == j
                            lo[side, at] = np.fmin(lo[side, at], low[mine[at]])
                            hi[side, at] = np.fmax(hi[side, at], high[mine[at]])
        if total[0].any():
            frame = {"i": iu.astype("int32"), "j": ju.astype("int32"), **dict(zip(_MOMENTS, total, strict=True))}
            yield pd.DataFrame({**frame, "lo_i": lo[0], "hi_i": hi[0], "lo_j": lo[1], "hi_j": hi[1]})

    return run


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pairwise Pearson r over pairwise-complete rows, long form
    ``(a, b, r)`` with both triangles and the diagonal.

    One scan: each task reduces its rows to one row a pair (``mapInPandas``) with the pair's
    count, means and co-moments about those means. The tasks' rows are merged about the
    overall means of the pair's own rows, so r is right wherever these rows lie. A
    column that is constant on the pair's rows (smallest = largest value), or has an infinite
    value there, gives null.

    A single SQL aggregation with k(k-1)/2 ``covar_samp``/``stddev_samp``
    triples would exceed the whole-stage codegen field limit and run
    interpreted (measured 50x slower at k = 9). The diagonal is 1 where the
    column varies, null otherwise.
    """
    cols = list(cols) if cols else numeric_column_names(df)
    vals = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    schema = "i int, j int, " + ", ".join(f"{c} double" for c in (*_MOMENTS, "lo_i", "hi_i", "lo_j", "hi_j"))
    parts = vals.mapInPandas(_partition_moments(cols), schema).filter("n > 0")
    pair = Window.partitionBy("i", "j")  # one row a task
    share = F.col("n") / F.sum("n").over(pair)
    # Means count from the pair's smallest one, so none of their digits is lost where all lie far from 0.
    parts = parts.withColumn("_w", share).withColumns({f"_o{x}": F.col(f"m{x}") - F.min(f"m{x}").over(pair) + F.col(f"l{x}") for x in "ij"})
    parts = parts.withColumns({f"_m{x}": F.sum(F.col(f"_o{x}") * F.col("_w")).over(pair) for x in "ij"})
    di, dj, n = F.col("_oi") - F.col("_mi"), F.col("_oj") - F.col("_mj"), F.col("n")
    merged = parts.groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("qi") + n * di * di).alias("vx"),
        F.sum(F.col("qj") + n * dj * dj).alias("vy"),
        F.sum(F.col("c") + n * di * dj).alias("cxy"),
        *[f(f"{e}_{x}").alias(f"{e}_{x}") for e, f in (("lo", F.min), ("hi", F.max)) for x in "ij"],
    )
    flat = (F.col("lo_i") == F.col("hi_i")) | (F.col("lo_j") == F.col("hi_j"))
    infinite = F.greatest(*[F.abs(f"{e}_{x}") for e in ("lo", "hi") for x in "ij"]) == float("inf")
    plain = F.try_divide(F.col("cxy"), F.sqrt("vx") * F.sqrt("vy"))
    r = (
        F.when((F.col("n") < 2) | flat | infinite | F.isnan(plain), F.lit(None).cast("double"))
        .when(F.col("i") == F.col("j"), F.lit(1.0))
        .otherwise(F.greatest(F.least(plain, F.lit(1.0)), F.lit(-1.0)))
    )
    names = F.array(*[F.lit(c) for c in cols])
    a = F.element_at(names, F.col("i") + 1)
    b = F.element_at(names, F.col("j") + 1)
    both = F.when(
        F.col("i") == F.col("j"), F.array(F.struct(a.alias("a"), b.alias("b"), F.col("r")))
    ).otherwise(
        F.array(
            F.struct(a.alias("a"), b.alias("b"), F.col("r")),
            F.struct(b.alias("a"), a.alias("b"), F.col("r")),
        )
    )
    return merged.withColumn("r", r).select(F.inline(both))


def _yearly(df: DataFrame, value: str) -> DataFrame:
    return (
        df.filter(F.col("year").isNotNull())
        .groupBy("year")
        .agg(F.avg(value).alias(f"{value}_mean"))
    )


def linear_trend(df: DataFrame, value: str = "tavg") -> DataFrame:
    """Least-squares line of yearly mean ``value`` on year: slope,
    intercept, r and r^2 (r^2 = r * r), plus the number of years.

    Empty when there are fewer than two years (the reference draws nothing).
    """
    y = _yearly(df, value)
    m = F.col(f"{value}_mean")
    yr = F.col("year").cast("double")
    fit = y.agg(
        F.count(F.when(m.isNotNull(), F.lit(1))).alias("years"),
        F.regr_slope(m, yr).alias("slope"),
        F.regr_intercept(m, yr).alias("intercept"),
        pair_corr(yr, m).alias("r"),
    )
    return fit.filter(F.col("years") > 1).select(
        "slope",
        "intercept",
        "r",
        (F.col("r") * F.col("r")).alias("r2"),
        (F.col("slope") * F.lit(10.0)).alias("slope_decade"),
        F.col("years").cast("bigint").alias("years"),
    )


def trend_line(df: DataFrame, value: str = "tavg") -> DataFrame:
    """Yearly mean with the fitted value of the A20 line per year.

    The fit is a window over the yearly table (one row per year), so the
    rows are aggregated once.
    """
    y = _yearly(df, value)
    m = F.col(f"{value}_mean")
    yr = F.col("year").cast("double")
    every = Window.partitionBy()
    fitted = y.select(
        "year",
        f"{value}_mean",
        F.regr_slope(m, yr).over(every).alias("_b"),
        F.regr_intercept(m, yr).over(every).alias("_a"),
        F.count(m).over(every).alias("_years"),
    )
    return fitted.filter(F.col("_years") > 1).select(
        "year", f"{value}_mean", (F.col("_a") + F.col("_b") * F.col("year")).alias("fitted")
    )
