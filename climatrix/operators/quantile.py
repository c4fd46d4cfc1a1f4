"""Exact quantiles by counting passes.

Spark's ``percentile`` keeps a value -> count map per group and merges it in
one task; with a hot group of mostly distinct doubles that map is unbounded.
Here no row is moved unless there are very many groups:

1. One aggregate gives each group's count, smallest and largest value, and
   so the ranks that its quantiles need (two per quantile). Where a mergeable
   sketch is at hand (``stats`` has a column ``_sketch``), narrow intervals around
   the wanted ranks are read from it.
2. A pass counts the values of each interval in at most ``BINS`` bins (partial + final
   aggregate), with the smallest and largest value of each.
3. The bin that holds the rank is the next interval. It ends where its
   smallest and largest value are one: that is the rank's value.

The first pass has equal bins. An interval that still spans more than an octave then gets bins that
are parts of octaves, so values over any number of magnitudes end within a sixteenth of one; inside an octave
equal bins settle 17 of the 52 bits a pass. That makes five passes at most for any doubles; a sketch's
miss costs nothing more. Data of few distinct values, or with a sketch, mostly need one or two.
A group that holds a third of the rows is counted by all tasks.
The interval table (one row a group) is broadcast only if it has at most ``BROADCAST_ROWS``
rows; beyond that values meet it in ``SALT`` shares of each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climatrix.functions.safe import nan_to_null
from climatrix.session import materialize

#: Equal bins of an interval in a pass, and bins of an octave.
BINS = 1 << 17
OCTAVE_BINS = 16
BROADCAST_ROWS = 100_000
#: Shares that a group's values are dealt into where the interval table isn't broadcast.
SALT = 16
#: Ranks on either side of a wanted one that a sketch's interval covers, as a share of the group.
MARGIN = 0.02
#: Size parameter of the sketches (rank error well below ``MARGIN``).
SKETCH_K = 400


def values_of(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., _v)`` of the rows with a value and all keys; NaN counts as missing."""
    base = df.select(*by, nan_to_null(F.col(value).cast("double")).alias("_v"))
    return base.dropna(subset=[*by, "_v"])


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A materialized table, marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def met(values: DataFrame, table: DataFrame, by: list[str], rows: int) -> DataFrame:
    """``values`` with the columns of their group's row of ``table`` (``rows`` of them, one a group).

    Beyond ``BROADCAST_ROWS`` groups both sides are shuffled, each group in ``SALT`` shares, so a hot group's
    values spread over as many tasks.
    """
    if rows <= BROADCAST_ROWS:
        return values.join(F.broadcast(table), by)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    return values.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALT))).join(salted, [*by, "_salt"]).drop("_salt")


def _lerp(a: Column, b: Column, t: Column) -> Column:
    # numpy's linear interpolation (pandas quantile default).
    d = b - a
    return F.when(t >= F.lit(0.5), b - d * (F.lit(1.0) - t)).otherwise(a + d * t)


def _ends(lo: Column, hi: Column, below: Column, bins: int = BINS) -> Column:
    """An interval: its ends, the number of values below it, its bins, and whether they are parts of octaves."""
    return F.struct(lo.alias("lo"), hi.alias("hi"), below.cast("bigint").alias("below"), F.lit(bins).alias("bins"), F.lit(False).alias("octaves"))


def _narrowed(lo: Column, hi: Column, below: Column) -> Column:
    """An interval found by a pass: its bins are equal if its ends lie within an octave, else they cut the octaves."""
    within = ((lo > 0) & (hi <= 2 * lo)) | ((hi < 0) & (lo >= 2 * hi))
    return F.struct(lo.alias("lo"), hi.alias("hi"), below.cast("bigint").alias("below"), F.lit(BINS).alias("bins"), (~within).alias("octaves"))


def _bin() -> Column:
    """Bin of ``_v`` in the interval chosen for it; bins ascend with the values.

    Equal bins never hold all values of two different ones: halves keep the width finite for any two finite
    doubles, and infinities get bins of their own.
    """
    top, octave = 1.7976931348623157e308, F.floor((F.least(F.log2(F.abs("_v")), F.lit(1025.0)) + 1075) * OCTAVE_BINS) + 1
    v, lo, hi, bins = F.col("_v"), F.greatest("_lo", F.lit(-top)), F.least("_hi", F.lit(top)), F.col("_bins")
    width = hi / 2 - lo / 2
    place = F.floor(F.try_divide(v / 2 - lo / 2, width) * bins)
    inner = F.when(width > 0, F.least(place, bins - 1)).otherwise((v > lo).cast("bigint"))
    equal = F.when(v < lo, F.lit(-1)).when(v > hi, bins).otherwise(inner)
    return F.when(~F.col("_octaves"), equal).when(v == 0, F.lit(0)).when(v > 0, octave).otherwise(-octave).cast("bigint")


_FIELDS = ("lo", "hi", "bins", "octaves")


def _flat(state: DataFrame, by: list[str], intervals: int) -> DataFrame:
    """``state`` with a column for each field of each interval: cheaper to meet a value than an array."""
    return state.select(*by, *[F.get("_in", F.lit(i))[f].alias(f"_{f}{i}") for i in range(intervals) for f in _FIELDS])


def _place(intervals: int) -> Column:
    """Number of the interval that holds ``_v``; null if none. Narrow intervals (odd numbers) come before the wide ones that touch them."""
    at = F.lit(None).cast("int")
    for i in reversed([*range(1, intervals, 2), *range(0, intervals, 2)]):
        at = F.when((F.col("_v") >= F.col(f"_lo{i}")) & (F.col("_v") <= F.col(f"_hi{i}")), F.lit(i)).otherwise(at)
    return at


def _chosen(field: str, intervals: int) -> Column:
    out = F.col(f"_{field}0")
    for i in range(1, intervals):
        out = F.when(F.col("_at") == i, F.col(f"_{field}{i}")).otherwise(out)
    return out


def _passed(values: DataFrame, by: list[str], state: DataFrame, intervals: int, rows: int, whole: bool) -> DataFrame:
    """One pass: ``(by..., _a, _b, _start, _inside)`` for the bins that hold wanted ranks.

    ``state`` has one row a group: ``_in`` (intervals, apart from each other) and ``_ranks``. With
    ``whole`` they cover all values of the group and counts run on from one to the next; else each
    interval knows how many values are below it.
    """
    seen = met(values, _flat(state, by, intervals), by, rows).withColumn("_at", _place(intervals)).filter("_at IS NOT NULL")
    seen = seen.select(*by, "_v", "_at", *[_chosen(f, intervals).alias(f"_{f}") for f in _FIELDS]).select(*by, "_v", "_at", _bin().alias("_bin"))
    bins = seen.groupBy(*by, "_at", "_bin").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    scope = by if whole else [*by, "_at"]
    before = Window.partitionBy(*scope).orderBy("_at", "_bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = bins.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    counted = counted.join(small(state.select(*by, "_in", "_ranks"), rows), by)
    start = F.col("_before") if whole else F.col("_before") + F.get("_in", F.col("_at"))["below"]
    counted = counted.withColumn("_start", start)
    inside = F.filter("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_c")))
    hit = counted.withColumn("_inside", inside).filter("size(_inside) > 0")
    return materialize(hit.select(*by, "_a", "_b", "_start", "_inside"))


def _first_state(by: list[str], stats: DataFrame, ranks: Column, probs: Sequence[float]) -> tuple[DataFrame, int]:
    """The intervals of the first pass: around the wanted ranks by the sketch, with what lies between them, or the whole range."""
    lo, hi, none = F.col("_lo"), F.col("_hi"), F.lit(0)
    if "_sketch" not in stats.columns:
        return stats.select(*by, F.array(_ends(lo, hi, none)).alias("_in"), ranks.alias("_ranks")), 1
    at = [min(max(p + d, 0.0), 1.0) for p in sorted(set(probs)) for d in (-MARGIN, MARGIN)]
    cuts = F.call_function("kll_sketch_get_quantile_double", F.col("_sketch"), F.array(*map(F.lit, at)))
    inner = F.transform(cuts, lambda c: F.least(F.greatest(c, lo), hi))
    known = stats.select(*by, F.concat(F.array(lo), inner, F.array(hi)).alias("_cuts"), ranks.alias("_ranks"))
    # Closed intervals; a value at a border belongs to the first that holds it. What lies between two
    # narrow ones is counted in few bins: no wanted rank is expected there.
    cut = [F.get("_cuts", F.lit(i)) for i in range(len(at) + 2)]
    ends = [_ends(cut[i], cut[i + 1], none, BINS if i % 2 else 8) for i in range(len(cut) - 1)]
    return known.select(*by, F.array(*ends).alias("_in"), "_ranks"), len(ends)


def _ranked(values: DataFrame, by: list[str], stats: DataFrame, positions: list[Column], probs: Sequence[float]) -> DataFrame:
    """``(by..., rank, value)`` for the ranks around the wanted positions of every group."""
    ranks = F.array_distinct(F.array(*[f(h) for h in positions for f in (F.floor, F.ceil)]))
    flat = stats.filter("_lo = _hi").select(*by, F.explode(ranks).alias("rank"), F.col("_lo").alias("value"))
    found = [flat]
    state, intervals = _first_state(by, stats.filter("_lo < _hi"), ranks, probs)  # ``stats`` is materialized
    whole, rows = True, stats.filter("_lo < _hi").count()
    while rows:
        hit = _passed(values, by, state, intervals, rows, whole)
        found.append(hit.filter("_a = _b").select(*by, F.explode("_inside").alias("rank"), F.col("_a").alias("value")))
        left = hit.filter("_a < _b")
        if left.isEmpty():
            break
        # At most one interval for each wanted rank.
        state = left.groupBy(*by).agg(
            F.sort_array(F.collect_list(_narrowed(F.col("_a"), F.col("_b"), F.col("_start")))).alias("_in"), F.flatten(F.collect_list("_inside")).alias("_ranks")
        )
        state = materialize(state)
        whole, intervals, rows = False, 2 * len(positions), state.count()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def group_stats(values: DataFrame, keys: list[str], sketch: bool = False) -> DataFrame:
    """keys, n, _lo, _hi (and ``_sketch``) of every group of ``values`` (keys, _v)."""
    aggs = [F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    if sketch:
        aggs.append(F.call_function("kll_sketch_agg_double", F.col("_v"), F.lit(SKETCH_K)).alias("_sketch"))
    return values.groupBy(*keys).agg(*aggs)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    method: str = "exact",
    accuracy: int = 10_000,
) -> DataFrame:
    """Linear quantiles of ``value`` per group: ``(by..., n, <name_i>...)``.

    ``method='exact'``: counting passes (above). ``method='approx'``:
    ``percentile_approx`` (bounded sketch, approximate).
    """
    by = list(by)
    names = list(names) if names else [f"q{int(round(p * 100)):02d}" for p in probs]
    values = values_of(df, value, by)
    if method == "approx":
        q = F.percentile_approx("_v", [float(p) for p in probs], accuracy)
        return values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), q.alias("_q")).select(
            *by, "n", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]
        )
    if method != "exact":
        raise ValueError("method must be 'exact' or 'approx'")
    keys = by or ["_all"]  # one group: a constant key keeps every join an equi-join
    if not by:
        values = values.withColumn("_all", F.lit(0))
    stats = materialize(group_stats(values, keys, sketch=not by))
    return quantiles_from_stats(values, stats, probs, keys, names).select(*by, "n", *names)


def quantiles_from_stats(values: DataFrame, stats: DataFrame, probs: Sequence[float], keys: list[str], names: Sequence[str]) -> DataFrame:
    """``stats`` (keys, n, _lo, _hi, perhaps _sketch; materialized) with the exact quantiles of ``values`` (keys, _v)."""
    pos = [(F.col("n") - F.lit(1)) * F.lit(float(p)) for p in probs]
    ranks = _ranked(values, keys, stats, pos, probs)
    by_group = ranks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_m"))
    outs = [
        _lerp(F.element_at("_m", F.floor(h)), F.element_at("_m", F.ceil(h)), h - F.floor(h)).alias(name)
        for h, name in zip(pos, names, strict=True)
    ]
    return stats.join(by_group, keys).select("*", *outs)
