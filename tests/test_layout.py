"""Z-order layout: the same rows from fewer files and row groups."""

from __future__ import annotations

import bisect
import glob
import itertools
import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from climatrix.session import scratch_path
from climatrix.sources import layout


def _rows(spark, n=6000, seed=3):
    rnd = random.Random(seed)
    rows = [(i, f"2000-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}", 7 if rnd.random() < 0.35 else rnd.randint(0, 400), rnd.uniform(-90, 90), math.exp(rnd.gauss(0, 3))) for i in range(n)]
    rows += [(n, None, None, None, None), (n + 1, "2000-05-05", 7, float("nan"), 1.0)]
    return spark.createDataFrame(rows, "id int, d string, station long, lat double, size double").withColumn("date", F.col("d").cast("timestamp_ntz")).drop("d")


@pytest.fixture(scope="module")
def laid(spark):
    path = scratch_path(spark, "layout-test")
    df = _rows(spark)
    layout.write_zordered(df, path, ["date", "station", "lat"], least_files=64, row_group_bytes=4096)
    return df, path


BOXES = [
    {"date": ("2000-03-01", "2000-04-15")},
    {"station": (100, 140)},
    {"lat": (10.0, 30.0)},
    {"date": ("2000-03-01", "2000-05-01"), "station": (7, 7), "lat": (0.0, None)},
    {"date": (None, "2000-01-20"), "lat": (-90.0, -60.0)},
    {"station": (1000, 2000)},
]


@pytest.mark.parametrize("box", BOXES)
def test_a_box_equals_a_filter(spark, laid, box):
    df, path = laid
    want = df
    for c, (lo, hi) in box.items():
        kind = df.schema[c].dataType
        want = want.where((F.col(c) >= F.lit(lo).cast(kind) if lo is not None else F.lit(True)) & (F.col(c) <= F.lit(hi).cast(kind) if hi is not None else F.lit(True)))
    got = sorted(r["id"] for r in layout.read_box(spark, path, box).collect())
    assert got == sorted(r["id"] for r in want.collect())


def test_files_are_skipped_by_every_column(spark, laid):
    """64 files give each of three columns two bits: a narrow range of one column meets a quarter of the files, or a half beside a boundary."""
    _, path = laid
    for box, most in (({"date": ("2000-03-01", "2000-03-31")}, 0.5), ({"lat": (10.0, 20.0)}, 0.5), ({"station": (300, 320)}, 0.5), (BOXES[3], 0.4)):
        r = layout.skipped(spark, path, box).first()
        assert r["files"] == 64 and r["files_read"] <= most * r["files"], (box, r)


def test_statistics_skip_row_groups(laid):
    """Measured on the files' footers: the share of row groups that a two-sided filter on the last column leaves."""
    _, path = laid
    groups = kept = 0
    for name in glob.glob(f"{path.removeprefix('file:')}/data/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index("station")
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            groups += 1
            kept += s is None or not s.has_min_max or (s.max >= 300 and s.min <= 320)
    assert groups >= 64 and kept <= groups / 2


def test_a_hot_key_is_spread(spark, laid):
    df, path = laid
    rows = [r["rows"] for r in spark.read.parquet(f"{path}/manifest").collect()]
    assert sum(rows) == df.count() and max(rows) <= 6 * sum(rows) / len(rows)
    hot = spark.read.parquet(f"{path}/data").where("station = 7").select(F.col("_metadata.file_path")).distinct().count()
    assert hot >= 10


def test_buckets_and_bits_by_brute_force(spark):
    cuts = [1.0, 2.0, 2.0, 2.0, 5.5, 9.0, 11.0]
    values = [-1.0, 1.0, 1.5, 2.0, 2.1, 5.5, 10.0, 11.0, 99.0]
    got = layout.with_buckets(spark.createDataFrame([(v,) for v in values], "v double"), {"b": (F.col("v"), cuts), "none": (F.col("v"), [])}).collect()
    assert {r["none"] for r in got} == {0} and all(r["b"] == bisect.bisect_right(cuts, r["v"]) for r in got)

    def mixed(*xs):
        return int("".join("".join(bits) for bits in zip(*[f"{x:03b}" for x in xs], strict=True)), 2)

    triples = list(itertools.product(range(8), repeat=3))
    made = spark.createDataFrame(triples, "a int, b int, c int").select("*", layout.interleaved([F.col(c) for c in "abc"], 3).alias("z")).collect()
    assert all(r["z"] == mixed(r["a"], r["b"], r["c"]) for r in made)


def test_odd_tables(spark):
    empty = _rows(spark, 0).limit(0)
    path = scratch_path(spark, "layout-empty")
    layout.write_zordered(empty, path, ["date", "station"])
    assert layout.read_box(spark, path, {"station": (0, 9)}).count() == 0 and layout.skipped(spark, path, {"station": (0, 9)}).first()["files_read"] == 0
    same = spark.range(500).select(F.lit(1).alias("_z"), F.lit(2.0).alias("v"), "id")
    path = scratch_path(spark, "layout-same")
    layout.write_zordered(same, path, ["v", "_z"])
    assert layout.read_box(spark, path, {"v": (2.0, 2.0)}).columns == ["_z", "v", "id"] and layout.read_box(spark, path, {"v": (2.0, 2.0)}).count() == 500
    with pytest.raises(TypeError):
        layout.write_zordered(spark.createDataFrame([("a",)], "s string"), scratch_path(spark, "layout-text"), ["s"])
