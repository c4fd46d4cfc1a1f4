"""Property tests (hypothesis): invariants over random small frames."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from climatrix.operators import bins, prepare

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

values = st.one_of(st.none(), st.just(float("nan")), st.floats(-50, 50, allow_nan=False).map(lambda v: round(v, 2)))
long_rows = st.lists(
    st.tuples(st.integers(0, 4), st.sampled_from(["A", "B", "C"]), values), min_size=1, max_size=40
)


@SETTINGS
@given(long_rows)
def test_pivot_equals_pandas_pivot_table(spark, rows):
    df = spark.createDataFrame(rows, "k int, datatype string, value double")
    got = {r["k"]: (r["A"], r["B"], r["C"]) for r in prepare.pivot_observations(df, ["A", "B", "C"], keys=["k"]).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "datatype", "value"]).astype({"value": "float64"})
    ref = pdf.pivot_table(index="k", columns="datatype", values="value", aggfunc="mean")
    want = {}
    for k, row in ref.iterrows():
        cells = tuple(None if (c not in row or pd.isna(row[c])) else float(row[c]) for c in "ABC")
        if any(v is not None for v in cells):
            want[int(k)] = cells
    assert got.keys() == want.keys()
    for k in got:
        for a, b in zip(got[k], want[k]):
            assert (a is None and b is None) or a == pytest.approx(b)


@SETTINGS
@given(st.lists(values, min_size=1, max_size=60), st.integers(1, 30))
def test_histogram_counts_every_value_once(spark, vals, nbins):
    df = spark.createDataFrame([(v,) for v in vals], "tavg double")
    h = bins.histogram(df, "tavg", nbins).collect()
    present = [v for v in vals if v is not None and not math.isnan(v)]
    if not present:
        assert h == []
        return
    assert len(h) == nbins
    assert sum(r["n"] for r in h) == len(present)
    want, edges = np.histogram(np.array(present), bins=nbins)
    assert [r["n"] for r in sorted(h, key=lambda r: r["bin"])] == want.tolist()
    assert min(r["lo"] for r in h) == edges[0] and max(r["hi"] for r in h) == edges[-1]


def test_scale_map_is_a_parameter(spark):
    df = spark.createDataFrame([("TMAX", 250.0), ("PRCP", 12.0), ("AWND", 3.0)], "datatype string, value double")
    default = {r["datatype"]: r["value"] for r in prepare.scale_units(df).collect()}
    assert default == {"TMAX": 25.0, "PRCP": 1.2, "AWND": 3.0}
    none = {r["datatype"]: r["value"] for r in prepare.scale_units(df, divisors={}).collect()}
    assert none == {"TMAX": 250.0, "PRCP": 12.0, "AWND": 3.0}
