"""Values of any magnitude: quantiles, correlations and bins that must not depend on the data's scale."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from climatrix.operators import bins, quantile, stats


PROBS = [0.1, 0.25, 0.5, 0.75]
SHAPES = {
    "octaves": lambda r: 2.0 ** r.uniform(-1000, 999) * r.choice([1, -1]),
    "uniform": lambda r: r.random(),
    "two values": lambda r: float(r.choice([1, 2])),
    "mostly zero": lambda r: r.choice([0.0, 0.0, 0.0, 1e-310, 3.0, float("inf")]),
    "close": lambda r: 1e9 + r.randrange(100) * 2.0**-23,
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
@pytest.mark.parametrize("broadcast", [True, False])
def test_quantiles_take_five_passes_at_most(spark, monkeypatch, shape, broadcast):
    rnd, passes = random.Random(7), []
    monkeypatch.setattr(quantile, "_passed", lambda *a, _old=quantile._passed, **k: passes.append(1) or _old(*a, **k))
    if not broadcast:
        monkeypatch.setattr(quantile, "BROADCAST_ROWS", 0)
    rows = [(SHAPES[shape](rnd), i % 3) for i in range(4000)]
    df = spark.createDataFrame(rows, "v double, g int")
    for by in ([], ["g"]):
        passes.clear()
        got = quantile.exact_quantiles(df, "v", PROBS, by).collect()
        assert len(passes) <= 5
        for r in got:
            own = [v for v, g in rows if not by or g == r.g]
            assert r.n == len(own) and np.allclose(list(r)[-4:], np.quantile(own, PROBS), rtol=1e-12, atol=0, equal_nan=True)


def test_quantiles_where_the_sketch_misses(spark, monkeypatch):
    """Ranks outside of the sketch's intervals are found all the same."""
    monkeypatch.setattr(quantile, "MARGIN", -0.2)
    rnd = random.Random(3)
    vals = [rnd.gauss(0, 1) for _ in range(3000)]
    row = quantile.exact_quantiles(spark.createDataFrame([(v,) for v in vals], "v double"), "v", PROBS).first()
    assert np.allclose(list(row)[1:], np.quantile(vals, PROBS), rtol=1e-12)


def test_describe_over_two_thousand_octaves(spark):
    vals = [2.0**e for e in range(-1000, 1000)]
    r = stats.describe(spark.createDataFrame([(v,) for v in vals], "v double")).first()
    assert np.allclose([r.p25, r.p50, r.p75], np.quantile(vals, [0.25, 0.5, 0.75]), rtol=1e-12) and (r.min, r.max) == (vals[0], vals[-1])


def _corr(spark, frame, parts=4):
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{c} double" for c in frame)).repartition(parts)
    return {(r.a, r.b): r.r for r in stats.correlation_matrix(df).collect()}


def test_correlation_of_rows_far_from_the_mean(spark):
    """Complete rows of a pair lie at 1e9, all other rows near -1.1e8."""
    rnd = np.random.default_rng(4)
    a = np.full(5000, -1e9 / 9) + rnd.normal(0, 1, 5000)
    a[:500] = 1e9 + rnd.normal(0, 1, 500)
    b = np.full(5000, np.nan)
    b[:500] = a[:500] - 1e9 + rnd.normal(0, 0.1, 500)
    frame = pd.DataFrame({"a": a, "b": b}).sample(frac=1, random_state=1)
    want = frame.corr().loc["a", "b"]
    got = _corr(spark, frame)
    assert want > 0.99 and abs(got["a", "b"] - want) < 1e-6 and got["a", "b"] == got["b", "a"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_correlation_with_nulls_placed_by_value(spark, data):
    seed = data.draw(st.integers(0, 10_000))
    rnd = np.random.default_rng(seed)
    n = data.draw(st.integers(2, 60))
    scale = data.draw(st.sampled_from([1e-6, 1.0, 1e8]))
    x = rnd.normal(0, 1, (n, 3)) * scale
    x[:, 1] += x[:, 0]
    cut = data.draw(st.floats(-1, 1)) * scale
    frame = pd.DataFrame(x, columns=list("abc"))
    frame.loc[frame["a"] > cut, "b"] = np.nan
    frame.loc[frame["b"] < -cut, "c"] = np.nan
    want, got = frame.corr(), _corr(spark, frame, 3)
    for a in "abc":
        for b in "abc":
            both = frame[[a, b]].dropna() if a != b else frame[[a]].dropna()
            r = got.get((a, b))
            if len(both) < 2 or (both.nunique() < 2).any():
                assert r is None
            else:
                assert math.isclose(r, want.loc[a, b], abs_tol=1e-9)


def test_correlation_of_infinite_and_constant_columns(spark):
    frame = pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0], "b": [1.0, math.inf, 0.0, 2.0], "c": [0.1] * 4})
    got = _corr(spark, frame)
    assert got["a", "b"] is None and got["a", "c"] is None and got["c", "c"] is None and got["a", "a"] == 1.0


def test_infinite_values_are_in_no_bin(spark):
    df = spark.createDataFrame([(v, float(i)) for i, v in enumerate([1.0, 2.0, 3.0, math.inf, -math.inf, None, math.nan])], "v double, w double")
    rows = bins.histogram(df, "v", 4).orderBy("bin").collect()
    assert [(r.lo, r.hi, r.n) for r in rows] == [(1.0, 1.5, 1), (1.5, 2.0, 0), (2.0, 2.5, 1), (2.5, 3.0, 1)]
    assert bins.infinite_values(df, "v").first() == (1, 1)
    assert sum(r.n for r in bins.density_2d(df, "v", "w").collect()) == 3
    assert sum(r.n for r in bins.grid_xy(df, "v", "w", None).collect()) == 3
    day = df.withColumn("date", F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(cast(w as int))"))
    assert sum(r.n for r in bins.grid_series(day, "date", "v").collect()) == 3
    assert sum(r.density for r in bins.violin_density(df.withColumn("g", F.lit("x")), "v", "g", 5).collect()) == pytest.approx(1)
    only = df.where("v = double('Infinity')")
    assert bins.histogram(only, "v", 4).count() == 0
