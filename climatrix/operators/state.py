"""Indicators kept up to date: (year, station) partials stored per batch, merged on reading.

A state is a folder:

* ``batch=<id>/`` holds the partials of one batch. Writing a batch again replaces its folder, so a
  batch that is repeated (a retried micro-batch, a page sent twice) counts once.
* ``merged/upto=<id>/`` holds the merged partials of all batches up to that one. A merged folder counts
  only once it is complete (its success marker is written last), so a compaction that dies halfway changes nothing.

Reading merges the newest complete ``merged`` folder and the batches after it; the facts
are never scanned again. Every partial merges by sum, extreme or the parallel variance update, so the result is
that of one scan over all batches, in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from climatrix.operators import kpi, rollup
from climatrix.operators.keys import station_key
from climatrix.session import scratch_path


def _folders(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    """Complete folders ``<prefix><number>`` below ``path``, by number."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name = status.getPath().getName()
        if name.startswith(prefix) and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            out[int(name[len(prefix) :])] = status.getPath().toString()
    return out


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Store the partials of the observations of one batch; the same batch again replaces them."""
    k = station_key(df)
    if k not in df.columns:
        raise ValueError("the observations need a station or station_key column")
    kpi.year_station_partials(df, ["year", k]).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _merge(per: DataFrame, k: str) -> DataFrame:
    return kpi.about_common_mean(per, ["year", k]).groupBy("year", k).agg(*kpi.merged_partials())


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    merged = _folders(spark, f"{path}/merged", "upto=")
    upto = max(merged, default=-1)
    after = {b: p for b, p in _folders(spark, path, "batch=").items() if b > upto}
    paths = ([merged[upto]] if merged else []) + [after[b] for b in sorted(after)]
    if not paths:
        return None, upto
    schema = spark.read.parquet(paths[0]).schema
    frames = [spark.read.schema(schema).parquet(p) for p in paths]
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out, max([upto, *after])


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """One row per (year, station) with the merged partials of all batches."""
    per, _ = _parts(spark, path)
    if per is None:
        raise ValueError(f"no batch below {path}")
    return _merge(per, "station_key" if "station_key" in per.columns else "station")


def compact(spark: SparkSession, path: str) -> int:
    """Merge all batches so far into one folder; returns the last batch in it. Batches up to it must not be written again."""
    per, last = _parts(spark, path)
    if per is not None:
        k = "station_key" if "station_key" in per.columns else "station"
        _merge(per, k).write.mode("overwrite").parquet(f"{path}/merged/upto={last}")
    return last


def maintain(observations: DataFrame, path: str, checkpoint_path: str | None = None, once: bool = True) -> StreamingQuery:
    """Keep the state of a stream of typed station-day rows: a micro-batch is a batch under its own number, so a retried one counts once."""
    ckpt = checkpoint_path or scratch_path(observations.sparkSession, "state-checkpoint")
    writer = observations.writeStream.option("checkpointLocation", ckpt).foreachBatch(lambda df, batch: append_batch(df, path, batch))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def dashboard(state: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """All headline indicators (A2-A7) from the state."""
    k = station_key(state, stations)
    measures = {"tavg", "prcp", "tmax", "tmin", "humidity", "solar_radiation", "wind_speed"}
    return kpi.indicators(kpi.roll_up(state, k, stations), measures, stations is not None)


def continent_year(state: DataFrame, stations: DataFrame) -> DataFrame:
    """A10 from the state."""
    return rollup.continent_year_of(state, stations, station_key(state, stations))
