"""Registered queries on stored, mergeable tables (sketches, pyramids, maintained states), with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from climatrix.functions.calendar import epoch_micros
from climatrix.operators import bins, lattice, prepare, pyramid, sketch, state
from climatrix.plans.catalog import register
from climatrix.plans.curate import station_day_from_long
from climatrix.plans.oracle import EV_OBS, MEASURES, NAMES, SQL, STATION_DAY, STATIONS
from climatrix.session import scratch_path
from climatrix.sources import feed, fixtures, layout
from climatrix.sql import register_functions

SKETCHED = ["tavg", "prcp", "humidity"]
YEARS = (1994, 1996)


# ------------------------------------------------------------- sketches
def _sketches(spark, sf):
    table = sketch.quantile_sketches(fixtures.measures(spark, sf), SKETCHED, ["year", "station_key"])
    return sketch.write_sketches(table, scratch_path(spark, "sketches"))


@register("sketch_quantiles")
def q_sketch_quantiles(spark, sf):
    """A18 of a range of years from stored sketches alone; says whether each quartile's true rank is within the stated error."""
    lo, hi = YEARS
    found = sketch.sketch_quantiles(_sketches(spark, sf).where(F.col("year").between(lo, hi)))
    facts = fixtures.measures(spark, sf).where(F.col("year").between(lo, hi))
    long = facts.select(F.stack(F.lit(len(SKETCHED)), *[x for c in SKETCHED for x in (F.lit(c), F.col(c))]).alias("measure", "v"))
    met = long.join(F.broadcast(found), "measure").groupBy("measure", "n", "lo", "hi")  # a row a measure
    error = sketch.rank_error()
    checks = []
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        below, upto = F.count_if(F.col("v") < F.col(name)) / F.count("v"), F.count_if(F.col("v") <= F.col(name)) / F.count("v")
        checks.append(((below <= p + error) & (upto >= p - error)).alias(f"{name}_within"))
    return met.agg(*checks)


@register("sketch_exact_quantiles")
def q_sketch_exact_quantiles(spark, sf):
    """Exact quartiles of a range of years, their first intervals read from stored sketches."""
    lo, hi = YEARS
    table = _sketches(spark, sf).where(F.col("year").between(lo, hi))
    return sketch.exact_quantiles(fixtures.measures(spark, sf).where(F.col("year").between(lo, hi)), table)


@register("sketch_exact_quantiles_by_year")
def q_sketch_exact_quantiles_by_year(spark, sf):
    """A26's quartiles per year, started from stored sketches."""
    return sketch.exact_quantiles(fixtures.measures(spark, sf), _sketches(spark, sf), by=["year"])


@register("sketch_stations")
def q_sketch_stations(spark, sf):
    """A3 from stored theta sketches: stations with warm days in any of the years, and in every one."""
    warm = fixtures.measures(spark, sf).where("tavg > 48")
    table = sketch.station_sketches(warm, "station")
    path = scratch_path(spark, "station-sketches")
    table.write.parquet(path)
    some = spark.read.parquet(path).where(F.col("year").between(*YEARS))
    return sketch.distinct_stations(some).select(F.lit("any").alias("years"), "stations").union(sketch.stations_in_all(some).select(F.lit("all"), "stations"))


_QUARTILES = "round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3"
_RANGE = f"year BETWEEN {YEARS[0]} AND {YEARS[1]}"
SQL["sketch_quantiles"] = "WITH " + MEASURES + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS measure, count({c}) AS n, round(min({c}), 6) AS lo, round(max({c}), 6) AS hi, true AS q1_within, true AS median_within, true AS q3_within FROM measures WHERE {_RANGE}"
    for c in SKETCHED
)
SQL["sketch_exact_quantiles"] = "WITH " + MEASURES + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS measure, count({c}) AS n, {_QUARTILES.format(c=c)} FROM measures WHERE {_RANGE}" for c in SKETCHED
)
SQL["sketch_exact_quantiles_by_year"] = "WITH " + MEASURES + "\n" + "\nUNION ALL\n".join(
    f"SELECT year, '{c}' AS measure, count({c}) AS n, {_QUARTILES.format(c=c)} FROM measures GROUP BY year" for c in SKETCHED
)
SQL["sketch_stations"] = (
    "WITH " + MEASURES + f",\nw AS (SELECT DISTINCT year, station FROM measures WHERE tavg > 48 AND {_RANGE}),\n"
    "c AS (SELECT station, count(*) AS years FROM w GROUP BY station)\n"
    "SELECT 'any' AS years, count(*) AS stations FROM c UNION ALL "
    "SELECT 'all', count(*) FILTER (years = (SELECT count(DISTINCT year) FROM w)) FROM c"
)


# -------------------------------------------------------------- pyramids
WINDOW = (-40.0, 75.5, -33.25, 60.0)
SERIES = (694224000000000.0, 946684800000000.0, -20.0, 60.0)  # 1992 to 2000 in microseconds, tavg


def _map_pyramid(spark, sf):
    finest = pyramid.station_cells(fixtures.measures(spark, sf), fixtures.stations(spark, sf))
    return pyramid.build(finest, scratch_path(spark, "pyramid"), by=["year"])


def _map_view(level):
    def q(spark, sf):
        return pyramid.view(_map_pyramid(spark, sf).where(F.col("year").between(*YEARS)), WINDOW, level)

    q.__doc__ = f"A22 zoomed: a window of the map at level {level} over a range of years, from the stored pyramid."
    return q


def _cell(v, lo, hi, level):
    return f"CAST(least(floor(({v} - ({lo})) / ({hi} - ({lo})) * {1 << level}), {(1 << level) - 1}) AS INTEGER)"


def _view_sql(head, src, x, y, extent, window, level):
    x0, x1, y0, y1 = extent
    i, j = _cell(x, x0, x1, level), _cell(y, y0, y1, level)
    (a, b), (c, d) = [[_cell(v, lo, hi, level) for v in pair] for pair, lo, hi in ((window[:2], x0, x1), (window[2:], y0, y1))]
    return (
        f"WITH {head}\nSELECT {i} AS x_bin, {j} AS y_bin, count(*) AS n, round(avg(tavg), 6) AS mean, round(min(tavg), 6) AS low, round(max(tavg), 6) AS high "
        f"FROM {src} WHERE {x} BETWEEN {x0} AND {x1} AND {y} BETWEEN {y0} AND {y1} AND {i} BETWEEN {a} AND {b} AND {j} BETWEEN {c} AND {d} GROUP BY 1, 2"
    )


for _level in (0, 5, 12):
    register(f"pyramid_map_{_level}")(_map_view(_level))
    SQL[f"pyramid_map_{_level}"] = _view_sql(
        f"{MEASURES},\n{STATIONS},\n{STATION_DAY},\np AS (SELECT * FROM station_day WHERE {_RANGE})", "p", "lon", "lat", pyramid.WORLD, WINDOW, _level
    )


@register("pyramid_series")
def q_pyramid_series(spark, sf):
    """A24 zoomed: one winter of the series at level 9."""
    pts = fixtures.measures(spark, sf).select(epoch_micros(F.col("date")).cast("double").alias("x"), "tavg")
    table = pyramid.build(pyramid.cells(pts, "x", "tavg", "tavg", SERIES, 10), scratch_path(spark, "series-pyramid"), 10)
    return pyramid.view(table, SERIES_WINDOW, 9, SERIES)


SERIES_WINDOW = (783648000000000.0, 796694400000000.0, 5.0, 42.0)
SQL["pyramid_series"] = _view_sql(f"{MEASURES},\np AS (SELECT CAST(epoch_us(date) AS DOUBLE) AS x, tavg FROM measures)", "p", "x", "tavg", SERIES, SERIES_WINDOW, 9)


# ------------------------------------------------------ maintained states
def _state(spark, sf):
    """Four batches of observations; the second is written twice, the first three are compacted."""
    path = scratch_path(spark, "state")
    m = fixtures.measures(spark, sf)
    for batch in (0, 1, 2, 1, 3):
        state.append_batch(m.where(F.pmod(F.xxhash64("obs_id"), F.lit(4)) == batch), path, batch)
        if batch == 2:
            state.compact(spark, path)
    return state.read_state(spark, path)


@register("state_dashboard")
def q_state_dashboard(spark, sf):
    """A2-A7 from partials maintained batch by batch."""
    return state.dashboard(_state(spark, sf), fixtures.stations(spark, sf))


@register("state_continent_year")
def q_state_continent_year(spark, sf):
    """A10 from partials maintained batch by batch."""
    return state.continent_year(_state(spark, sf), fixtures.stations(spark, sf))


SQL["state_dashboard"] = SQL["kpi_dashboard"]
SQL["state_continent_year"] = SQL["continent_year"]


# ------------------------------------------------- landing with versions
STREAMED = ["TMAX", "TMIN", "PRCP", "AWND", "SNOW"]


def _landed(spark, sf):
    """Pages of all events, some of them sent again later with corrected values, some repeated, and one that can't be read."""
    pages, landed, dead = (scratch_path(spark, f"versions-{x}") for x in ("pages", "landed", "dead"))
    obs = fixtures.observations_from_events(spark, sf)
    feed.write_feed_pages(obs.where("event_id div 1000 % 3 = 0").withColumn("value", F.col("value") + 10), pages, "event_id", fetched="2024-02-01")
    feed.write_feed_pages(obs, pages, "event_id", fetched="2024-01-01", mode="append")
    feed.write_feed_pages(obs.where("event_id div 1000 % 2 = 0"), pages, "event_id", fetched="2024-01-01", mode="append")
    spark.createDataFrame([('{"results": [{"date": "2024-01-',)], "value string").coalesce(1).write.mode("append").text(pages)
    from climatrix.streaming import land_versions

    land_versions(spark, pages, landed, dead, multi_line=False, max_files_per_trigger=10).awaitTermination()
    return landed, dead


@register("stream_versions")
def q_stream_versions(spark, sf):
    """S1 to P6 as streams: pages in any order, repeated and corrected, kept current by keyed state, then pivoted."""
    from climatrix.streaming import current_observations, keep_current

    landed, _ = _landed(spark, sf)
    current = scratch_path(spark, "versions-current")
    keep_current(spark, landed, current, max_files_per_trigger=20).awaitTermination()
    out = station_day_from_long(current_observations(spark, current), STREAMED)
    return out.select("date", "year", "month", "day", "day_of_year", "week", "station", "tmax", "tmin", "prcp", "wind_avg", "snow", "tavg")


@register("stream_dead_letters")
def q_stream_dead_letters(spark, sf):
    """What the landing put aside: the count of unreadable pages and records, beside the landed records."""
    from climatrix.streaming import dead_letters, landed_observations

    landed, dead = _landed(spark, sf)
    counts = landed_observations(spark, landed).agg(F.count(F.lit(1)).alias("landed"))
    bad = dead_letters(spark, dead).agg(F.count_if(F.col("reason") == "page").alias("bad_pages"), F.count_if(F.col("reason") == "record").alias("bad_records"))
    return counts.join(bad, F.lit(True))  # one row each


_AVG = ", ".join(f"avg(value) FILTER (WHERE datatype = '{c}') AS {NAMES[c]}" for c in STREAMED)
_PARTS = "CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(weekofyear(date) AS INTEGER) AS week"
SQL["stream_versions"] = f"""WITH {EV_OBS},
sent AS (
  SELECT date, datatype, station, attributes, value, 1 AS fetched FROM ev_obs
  UNION ALL SELECT date, datatype, station, attributes, value + 10, 2 FROM ev_obs WHERE event_id // 1000 % 3 = 0),
last AS (
  SELECT DISTINCT date, datatype, station, attributes, CASE WHEN datatype IN ('TMAX', 'TMIN', 'TAVG', 'PRCP') THEN value / 10 ELSE value END AS value
  FROM (SELECT * FROM sent WHERE date IS NOT NULL AND datatype IS NOT NULL AND station IS NOT NULL
        QUALIFY fetched = max(fetched) OVER (PARTITION BY date, datatype, station))),
wide AS (SELECT date, station, {_AVG} FROM last GROUP BY date, station HAVING count(value) > 0)
SELECT CAST(date AS VARCHAR) AS date, {_PARTS}, station, {", ".join(f"round({NAMES[c]}, 6) AS {NAMES[c]}" for c in STREAMED)}, round((tmax + tmin) / 2, 6) AS tavg
FROM wide"""
SQL["stream_dead_letters"] = f"""WITH {EV_OBS}
SELECT count(*) + count(*) FILTER (event_id // 1000 % 3 = 0) + count(*) FILTER (event_id // 1000 % 2 = 0) AS landed,
  CAST(1 AS BIGINT) AS bad_pages, CAST(0 AS BIGINT) AS bad_records FROM ev_obs"""


# ------------------------------------------- one scan for many tables
def _lattice_table(name):
    def q(spark, sf):
        return lattice.TABLES[name](lattice.lattice(fixtures.measures(spark, sf)))

    q.__doc__ = f"{name} from the lattice of grouping sets (one scan for all of its tables)."
    return q


for _name in lattice.TABLES:
    register(f"lattice_{_name}")(_lattice_table(_name))
    SQL[f"lattice_{_name}"] = SQL[_name]


@register("lattice_continent_year")
def q_lattice_continent_year(spark, sf):
    """continent_year from the lattice of grouping sets."""
    return lattice.continent_year(lattice.lattice(fixtures.measures(spark, sf)), fixtures.stations(spark, sf))


SQL["lattice_continent_year"] = SQL["continent_year"]


# ------------------------------------------------ stations that move
@register("attach_as_of")
def q_attach_as_of(spark, sf):
    """P7 with the attributes that a station had on the day: every station moved twice."""
    moves = F.explode(F.array(*[F.struct(F.lit(d).cast("timestamp_ntz").alias("valid_from"), F.lit(float(i)).alias("shift")) for i, d in enumerate(MOVES)]))
    history = fixtures.stations(spark, sf).withColumn("move", moves)
    history = history.select("station_key", "continent", (F.col("lat") + F.col("move.shift")).alias("lat"), F.col("move.valid_from").alias("valid_from"))
    return prepare.attach_attributes_as_of(fixtures.measures(spark, sf), history).select("obs_id", "station", "date", "tavg", "continent", "lat")


MOVES = ("1993-06-01", "1994-07-15", "1997-01-01")
SQL["attach_as_of"] = f"""WITH {MEASURES},
{STATIONS},
history AS (SELECT station_key, continent, lat + i AS lat, CAST(d AS TIMESTAMP) AS valid_from
  FROM stations, (VALUES {", ".join(f"('{d}', {i})" for i, d in enumerate(MOVES))}) m(d, i))
SELECT m.obs_id, m.station, CAST(m.date AS VARCHAR) AS date, round(m.tavg, 6) AS tavg, h.continent, round(h.lat, 6) AS lat
FROM measures m ASOF LEFT JOIN history h ON m.station_key = h.station_key AND m.date >= h.valid_from"""


# ---------------------------------------------------- smoothed violins
@register("violin_kernel")
def q_violin_kernel(spark, sf):
    """A27 smoothed, by continent."""
    return bins.violin_kernel(fixtures.measures(spark, sf), "tavg", "continent", 64, stations=fixtures.stations(spark, sf))


@register("violin_kernel_by_month")
def q_violin_kernel_by_month(spark, sf):
    """A27 smoothed with two keys: month and continent."""
    return bins.violin_kernel(fixtures.measures(spark, sf), "tavg", ["month", "continent"], 32, stations=fixtures.stations(spark, sf))


def _kernel_sql(by, points):
    names = ", ".join(by)
    on = " AND ".join(f"a.{c} = b.{c}" for c in by)
    return f"""WITH {MEASURES},
{STATIONS},
{STATION_DAY},
p AS (SELECT {names}, tavg AS v FROM station_day WHERE tavg IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in by)}),
g AS (
  SELECT *, lo - {bins.VIOLIN_CUT} * bandwidth AS start, (hi - lo + {2 * bins.VIOLIN_CUT} * bandwidth) / {points - 1} AS step FROM (
    SELECT {names}, count(*) AS n, min(v) AS lo, max(v) AS hi, {bins.SILVERMAN!r}::DOUBLE * stddev_samp(v) * pow(count(*), -0.2) AS bandwidth FROM p GROUP BY {names})
  WHERE lo < hi),
w AS (
  SELECT {names}, j, sum(w) AS w FROM (
    SELECT {names}, unnest([low, low + 1]) AS j, unnest([1 - (pos - low), pos - low]) AS w FROM (
      SELECT {names}, pos, least(floor(pos), {points - 2}) AS low FROM (SELECT {", ".join("a." + c for c in by)}, (v - start) / step AS pos FROM p a JOIN g b ON {on})))
  GROUP BY {names}, j),
d AS (
  SELECT {", ".join("b." + c for c in by)}, k AS point, any_value(n) AS n, any_value(bandwidth) AS bandwidth, any_value(start) AS start, any_value(step) AS step,
    sum(w * exp(-0.5 * pow((k - j) * step / bandwidth, 2))) AS d
  FROM w a JOIN g b ON {on}, (SELECT unnest(range(0, {points})) AS k) GROUP BY {", ".join("b." + c for c in by)}, k)
SELECT {names}, CAST(point AS INTEGER) AS point, round(start + point * step, 6) AS x, round(d / (sum(d) OVER (PARTITION BY {names}) * step), 6) AS density,
  round(bandwidth, 6) AS bandwidth, n FROM d"""


SQL["violin_kernel"] = _kernel_sql(["continent"], 64)
SQL["violin_kernel_by_month"] = _kernel_sql(["month", "continent"], 32)


# ------------------------------------------------------- Z-order layout
ZORDERED = ["date", "station_key", "lat", "lon"]
BOX = {"date": ("1994-03-01", "1995-02-28"), "lat": (-20.0, 35.0), "lon": (-100.0, 20.0)}


def _laid_out(spark, sf):
    days = prepare.attach_station_attributes(fixtures.measures(spark, sf), fixtures.stations(spark, sf))
    path = scratch_path(spark, "zordered")
    layout.write_zordered(days.select("obs_id", *ZORDERED, "tavg"), path, ZORDERED, least_files=64)
    return path


@register("zorder_box")
def q_zorder_box(spark, sf):
    """S2 on a table in Z-order of date, station, lat and lon: a box of dates and places, read from the files that can hold any of its rows."""
    return layout.read_box(spark, _laid_out(spark, sf), BOX)


@register("zorder_skipped")
def q_zorder_skipped(spark, sf):
    """What the layout spares: all rows, and whether a box of dates and places leaves out at least half of them, and a year of one tenth of the stations as well."""
    path = _laid_out(spark, sf)
    last = fixtures.stations(spark, sf).agg(F.max("station_key")).first()[0]
    one = layout.skipped(spark, path, BOX)
    other = layout.skipped(spark, path, {"date": BOX["date"], "station_key": (0, last // 10)})
    half = F.col("rows_read") * 2 <= F.col("rows")
    return one.select(F.lit("places").alias("box"), "rows", half.alias("half_skipped")).union(other.select(F.lit("stations"), "rows", half))


_IN_BOX = f"date BETWEEN TIMESTAMP '{BOX['date'][0]}' AND TIMESTAMP '{BOX['date'][1]}' AND lat BETWEEN {BOX['lat'][0]} AND {BOX['lat'][1]} AND lon BETWEEN {BOX['lon'][0]} AND {BOX['lon'][1]}"
SQL["zorder_box"] = f"""WITH {MEASURES},
{STATIONS},
{STATION_DAY}
SELECT obs_id, CAST(date AS VARCHAR) AS date, station_key, round(lat, 6) AS lat, round(lon, 6) AS lon, round(tavg, 6) AS tavg FROM station_day WHERE {_IN_BOX}"""
SQL["zorder_skipped"] = f"WITH {MEASURES} SELECT unnest(['places', 'stations']) AS box, count(*) AS rows, true AS half_skipped FROM measures"


# ------------------------------------------------------- table functions
def _called(call):
    def q(spark, sf):
        register_functions(spark, fixtures.measures(spark, sf), fixtures.stations(spark, sf))
        return spark.sql(call)

    q.__doc__ = f"The table functions of ``spark.sql``: {call}"
    return q


CALLS = {
    "sql_dashboard": "SELECT * FROM climate_dashboard()",
    "sql_summary": "SELECT * FROM climate_summary()",
    "sql_yearly_temperature": f"SELECT * FROM climate_yearly_temperature({YEARS[0]}, {YEARS[1]})",
    "sql_warm_years": f"SELECT year, count(*) AS days FROM climate_warm_days(20, {YEARS[0]}, {YEARS[1]}) GROUP BY year",
    "sql_asian_days": f"SELECT obs_id, tavg, lat FROM climate_days_at({YEARS[0]}, {YEARS[1]}, 'ASIA')",
    "sql_anomaly": f"SELECT c.year, c.continent, c.tavg_mean - y.tavg_mean AS anomaly FROM climate_continent_year({YEARS[0]}, {YEARS[1]}) c "
    f"JOIN climate_yearly_temperature({YEARS[0]}, {YEARS[1]}) y ON c.year = y.year",
}
for _name, _call in CALLS.items():
    register(_name)(_called(_call))

SQL["sql_dashboard"] = SQL["kpi_dashboard"]
SQL["sql_summary"] = SQL["kpi_summary"]
SQL["sql_yearly_temperature"] = f"SELECT * FROM ({SQL['yearly_temperature']}) WHERE {_RANGE}"
SQL["sql_warm_years"] = f"WITH {MEASURES} SELECT year, count(*) AS days FROM measures WHERE tavg > 20 AND {_RANGE} GROUP BY year"
SQL["sql_asian_days"] = f"""WITH {MEASURES},
{STATIONS},
{STATION_DAY}
SELECT obs_id, round(tavg, 6) AS tavg, round(lat, 6) AS lat FROM station_day WHERE continent = 'ASIA' AND {_RANGE}"""
SQL["sql_anomaly"] = f"""WITH {MEASURES},
{STATIONS},
{STATION_DAY},
y AS (SELECT year, avg(tavg) AS m FROM measures GROUP BY year)
SELECT s.year, s.continent, round(avg(s.tavg) - any_value(y.m), 6) AS anomaly FROM station_day s JOIN y ON s.year = y.year
WHERE s.continent IS NOT NULL AND s.year BETWEEN {YEARS[0]} AND {YEARS[1]} GROUP BY s.year, s.continent"""
