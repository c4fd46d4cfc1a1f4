"""DuckDB twins of the registered queries (same parquet tables, same names).

Each string is self-contained: it rebuilds the climate model from the
driver's tables with CTEs that mirror ``climatrix.sources.fixtures``.
Doubles are rounded to 6 decimals and integer columns cast to the Spark
types (DuckDB's ``year()`` is BIGINT).
"""

from __future__ import annotations

MEASURES = """measures AS (
  SELECT
    concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
              CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
              strftime(l_shipdate, '%Y%m%d')) AS obs_id,
    l_shipdate AS date,
    CAST(year(l_shipdate) AS INTEGER) AS year,
    CAST(month(l_shipdate) AS INTEGER) AS month,
    CAST(day(l_shipdate) AS INTEGER) AS day,
    CAST(dayofyear(l_shipdate) AS INTEGER) AS day_of_year,
    CAST(weekofyear(l_shipdate) AS INTEGER) AS week,
    printf('ST%04d', l_suppkey) AS station,
    l_suppkey AS station_key,
    l_quantity AS tmax,
    l_quantity - 100 * l_discount AS tmin,
    (l_quantity + (l_quantity - 100 * l_discount)) / 2 AS tavg,
    100 * l_tax AS prcp,
    CAST(30 + l_partkey % 61 AS DOUBLE) AS humidity,
    200 * l_discount AS wind_speed,
    CAST(100 + l_partkey % 701 AS DOUBLE) AS solar_radiation
  FROM lineitem)"""

STATIONS = """stations AS (
  SELECT printf('ST%04d', s_suppkey) AS station, s_suppkey AS station_key, r_name AS continent, n_name AS country,
         CAST((s_suppkey * 37) % 181 - 90 AS DOUBLE) AS lat,
         CAST((s_suppkey * 73) % 361 - 180 AS DOUBLE) AS lon,
         CAST((s_suppkey * 29) % 3000 AS DOUBLE) AS elevation
  FROM supplier
  LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) g
    ON s_nationkey = g.n_nationkey)"""

STATION_DAY = """station_day AS (
  SELECT m.*, s.continent, s.country, s.lat, s.lon, s.elevation
  FROM measures m LEFT JOIN stations s ON m.station_key = s.station_key)"""

EV_OBS = """ev_obs AS (
  SELECT event_id,
         CAST(CAST(ts AS DATE) AS TIMESTAMP) AS date,
         CASE event_type WHEN 'view' THEN 'TMAX' WHEN 'click' THEN 'TMIN'
              WHEN 'purchase' THEN 'PRCP' WHEN 'signup' THEN 'AWND'
              WHEN 'error' THEN 'SNOW' END AS datatype,
         CAST(user_id AS VARCHAR) AS station,
         props AS attributes,
         value
  FROM events)"""

EV_PREP = """ev_prep AS (
  SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
         CAST(day(date) AS INTEGER) AS day, CAST(dayofyear(date) AS INTEGER) AS day_of_year,
         CAST(weekofyear(date) AS INTEGER) AS week, station, datatype,
         CASE WHEN datatype IN ('TMAX', 'TMIN', 'TAVG', 'PRCP') THEN value / 10 ELSE value END AS value
  FROM ev_obs)"""

PRESENT = ["TMAX", "TMIN", "PRCP", "SNOW", "AWND"]  # codes with records in ev_obs
CODES = ["TMAX", "TMIN", "TAVG", "PRCP", "SNOW", "SNWD", "AWND", "WSF2", "WDF2", "WSF5"]
NAMES = {
    "TMAX": "tmax", "TMIN": "tmin", "TAVG": "tavg", "PRCP": "prcp", "SNOW": "snow",
    "SNWD": "snow_depth", "AWND": "wind_avg", "WSF2": "wind_fastest", "WDF2": "wind_direction",
    "WSF5": "wind_gust",
}
KEYS = "date, year, month, day, day_of_year, week, station"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _m() -> str:
    return _with(MEASURES)


def _sd() -> str:
    return _with(MEASURES, STATIONS, STATION_DAY)


def _pivot(codes: list[str], rename: bool, rounded: bool = True) -> str:
    aggs = ", ".join(
        (
            f"round(avg(value) FILTER (WHERE datatype = '{c}'), 6)"
            if rounded
            else f"avg(value) FILTER (WHERE datatype = '{c}')"
        )
        + f" AS {NAMES[c] if rename else c}"
        for c in codes
    )
    having = " OR ".join(f"count(value) FILTER (WHERE datatype = '{c}') > 0" for c in codes)
    return (
        _with(EV_OBS, EV_PREP)
        + f"SELECT {KEYS}, {aggs} FROM ev_prep WHERE date IS NOT NULL AND station IS NOT NULL "
        f"GROUP BY {KEYS} HAVING {having}"
    )


def _bin(v: str, lo: str, hi: str, n: int) -> str:
    return (
        f"CAST(CASE WHEN {hi} > {lo} THEN least(floor(({v} - {lo}) / ({hi} - {lo}) * {n}), {n - 1}) "
        f"ELSE 0 END AS INTEGER)"
    )


def _grid(src: str, x: str, y: str, w: int, h: int, agg: str) -> str:
    return (
        f"SELECT {_bin(x, 'x0', 'x1', w)} AS x_bin, {_bin(y, 'y0', 'y1', h)} AS y_bin, {agg} "
        f"FROM {src}, (SELECT min({x}) x0, max({x}) x1, min({y}) y0, max({y}) y1 FROM {src}) e "
        f"GROUP BY 1, 2"
    )


def _resample(freq: str) -> str:
    label = {
        "D": "CAST(date AS DATE)",
        "W": "CAST(date AS DATE) + CAST(7 - isodow(date) AS INTEGER)",
        "M": "last_day(CAST(date AS DATE))",
        "Q": "last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE))",
        "Y": "make_date(year(date), 12, 31)",
    }[freq]
    cal = {
        "D": "SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS p FROM ext",
        "W": "SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS p FROM ext",
        "M": "SELECT last_day(CAST(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), "
        "INTERVAL 1 MONTH)) AS DATE)) AS p FROM ext",
        "Q": "SELECT last_day(CAST(s + INTERVAL 2 MONTH AS DATE)) AS p FROM (SELECT unnest(generate_series("
        "date_trunc('quarter', lo), date_trunc('quarter', hi), INTERVAL 3 MONTH)) AS s FROM ext)",
        "Y": "SELECT make_date(CAST(unnest(generate_series(year(lo), year(hi))) AS INTEGER), 12, 31) AS p FROM ext",
    }[freq]
    return (
        _with(MEASURES)
        + f", means AS (SELECT {label} AS p, avg(tavg) AS m FROM measures "
        "WHERE date IS NOT NULL AND tavg IS NOT NULL GROUP BY 1),\n"
        "ext AS (SELECT min(p) AS lo, max(p) AS hi FROM means HAVING min(p) IS NOT NULL),\n"
        f"cal AS ({cal})\n"
        "SELECT CAST(cal.p AS TIMESTAMP) AS period, round(means.m, 6) AS tavg_mean "
        "FROM cal LEFT JOIN means ON cal.p = means.p"
    )


PROFILE = ["tavg", "tmax", "tmin", "prcp", "humidity", "wind_speed"]
SHOWN = {"prcp": 100.0, "humidity": 100.0, "wind_speed": 20.0}


def _profile(slice_where: str | None) -> str:
    g = ", ".join(f"min({m}) AS gl{i}, max({m}) AS gh{i}, avg({m}) AS gm{i}" for i, m in enumerate(PROFILE))
    parts = []
    for i, m in enumerate(PROFILE):
        mean = f"ym{i}" if slice_where else f"gm{i}"
        norm = f"({mean} - gl{i}) / NULLIF(gh{i} - gl{i}, 0)"
        year = "year, " if slice_where else ""
        parts.append(
            f"SELECT {year}'{m}' AS measure, round({mean}, 6) AS mean, round(gl{i}, 6) AS min, "
            f"round(gh{i}, 6) AS max, round({norm}, 6) AS normalised, "
            f"round({norm} / {SHOWN.get(m, 1.0)}, 6) AS shown FROM {'s, ' if slice_where else ''}g"
        )
    head = _with(MEASURES) + f", g AS (SELECT {g} FROM measures)"
    if slice_where:
        s = ", ".join(f"avg({m}) AS ym{i}" for i, m in enumerate(PROFILE))
        head += f", s AS (SELECT year, {s} FROM measures WHERE {slice_where} GROUP BY year)"
    return head + "\n" + "\nUNION ALL\n".join(parts)


CORR_COLUMNS = ["tmax", "tmin", "tavg", "prcp", "humidity", "wind_speed", "solar_radiation", "year", "month"]


def _corr() -> str:
    cols = CORR_COLUMNS
    exprs, rows = [], []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a, b = f"CAST({cols[i]} AS DOUBLE)", f"CAST({cols[j]} AS DOUBLE)"
            exprs.append(
                f"covar_samp({a}, {b}) / NULLIF(stddev_samp({a}) FILTER (WHERE {b} IS NOT NULL) * "
                f"stddev_samp({b}) FILTER (WHERE {a} IS NOT NULL), 0) AS r_{i}_{j}"
            )
            rows.append(f"SELECT '{cols[i]}' AS a, '{cols[j]}' AS b, round(r_{i}_{j}, 6) AS r FROM w")
            rows.append(f"SELECT '{cols[j]}' AS a, '{cols[i]}' AS b, round(r_{i}_{j}, 6) AS r FROM w")
        exprs.append(f"CASE WHEN stddev_samp(CAST({cols[i]} AS DOUBLE)) > 0 THEN 1.0 END AS r_{i}_{i}")
        rows.append(f"SELECT '{cols[i]}' AS a, '{cols[i]}' AS b, CAST(r_{i}_{i} AS DOUBLE) AS r FROM w")
    return _m() + f", w AS (SELECT {', '.join(exprs)} FROM measures)\n" + "\nUNION ALL\n".join(rows)


def _sample(src: str, cols: str, key: str, n: int, prefix: str = "") -> str:
    return (
        prefix
        + f"SELECT {cols} FROM {src} ORDER BY md5(CAST({key} AS VARCHAR) || ':42'), {key} LIMIT {n}"
    )


YEARLY_TREND = (
    "y AS (SELECT year, avg(tavg) AS m FROM measures WHERE year IS NOT NULL GROUP BY year)"
)

EXPORT = (
    "SELECT obs_id, year, month, station, round(tavg, 6) AS tavg, round(prcp, 6) AS prcp, "
    "round(humidity, 6) AS humidity FROM measures"
)
OBS = (
    "obs AS (SELECT date, 'TMAX' AS datatype, station, CAST(NULL AS VARCHAR) AS attributes, tmax * 10 AS value FROM measures "
    "UNION ALL SELECT date, 'TMIN', station, NULL, tmin * 10 FROM measures "
    "UNION ALL SELECT date, 'PRCP', station, NULL, prcp * 10 FROM measures)\n"
)
PARALLEL = (
    "round(tavg, 6) AS tavg, round(tmax, 6) AS tmax, round(tmin, 6) AS tmin, round(prcp, 6) AS prcp, "
    "round(humidity, 6) AS humidity, round(wind_speed, 6) AS wind_speed, year"
)
SCATTER = "round(tavg, 6) AS tavg, round(prcp, 6) AS prcp, round(humidity, 6) AS humidity, continent, station, round(solar_radiation, 6) AS size"


def _number(text: str) -> str:
    """Numeric text as double, other text as null."""
    pattern = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
    return f"CASE WHEN regexp_matches({text}, '{pattern}') THEN TRY_CAST(trim({text}) AS DOUBLE) END"


def _describe(cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM measures"
        for c in cols
    )


def _box(src: str, value: str, by: str) -> str:
    return (
        f"q AS (SELECT {by}, count({value}) AS n, quantile_cont({value}, 0.25) AS q1, "
        f"quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3 FROM {src} "
        f"WHERE {by} IS NOT NULL AND {value} IS NOT NULL GROUP BY {by}),\n"
        "f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)\n"
        f"SELECT f.{by}, any_value(f.n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, "
        "round(any_value(q3), 6) AS q3, round(any_value(lower_fence), 6) AS lower_fence, "
        "round(any_value(upper_fence), 6) AS upper_fence, "
        f"round(min({value}) FILTER (WHERE {value} >= lower_fence), 6) AS whisker_low, "
        f"round(max({value}) FILTER (WHERE {value} <= upper_fence), 6) AS whisker_high, "
        f"count(*) FILTER (WHERE {value} < lower_fence OR {value} > upper_fence) AS outliers "
        f"FROM f JOIN {src} e ON f.{by} = e.{by} WHERE e.{value} IS NOT NULL GROUP BY f.{by}"
    )


def _edge(i: str, n: int) -> str:
    return f"CASE WHEN {i} = {n} THEN hi ELSE {i} * ((hi - lo) / {n}.0::DOUBLE) + lo END"


def _histogram(n: int) -> str:
    """Counts of ``v`` by the edges of ``n`` equal bins."""
    return (
        "x AS (SELECT min(v) AS a, max(v) AS z FROM v HAVING min(v) IS NOT NULL),\n"
        "e AS (SELECT CASE WHEN a = z THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = z THEN z + 0.5 ELSE z END AS hi FROM x),\n"
        f"r AS (SELECT v, lo, hi, least(floor((v - lo) / (hi - lo) * {n}), {n - 1}) AS b FROM v, e),\n"
        f"d AS (SELECT v, lo, hi, CASE WHEN v < {_edge('b', n)} THEN b - 1 ELSE b END AS b FROM r),\n"
        f"c AS (SELECT CAST(CASE WHEN v >= {_edge('(b + 1)', n)} AND b <> {n - 1} THEN b + 1 ELSE b END AS INTEGER) AS bin, count(*) AS n FROM d GROUP BY 1),\n"
        f"b AS (SELECT CAST(range AS INTEGER) AS bin, lo, hi FROM range(0, {n}), e)\n"
        f"SELECT b.bin, round({_edge('b.bin', n)}, 6) AS lo, round({_edge('(b.bin + 1)', n)}, 6) AS hi, "
        "CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM b LEFT JOIN c ON b.bin = c.bin"
    )


#: Days on which ``tavg`` is finite in the queries with infinite values.
FINITE = "humidity NOT IN (30, 31)"


SQL: dict[str, str] = {
    # sources
    "unnest_results": _with(EV_OBS)
    + "SELECT date, datatype, station, attributes, round(value, 6) AS value FROM ev_obs",
    "stream_ingest": _with(EV_OBS)
    + "SELECT date, datatype, station, attributes, round(CASE WHEN datatype IN ('TMAX', 'TMIN', 'TAVG', 'PRCP') "
    "THEN value / 10 ELSE value END, 6) AS value, CAST(year(date) AS INTEGER) AS year FROM ev_obs",
    "prepare_feed": f"SELECT {KEYS}, round(tmax, 6) AS tmax, round(tmin, 6) AS tmin, round(prcp, 6) AS prcp, "
    "round(wind_avg, 6) AS wind_avg, round(snow, 6) AS snow, round((tmax + tmin) / 2, 6) AS tavg FROM ("
    + _pivot(["TMAX", "TMIN", "PRCP", "AWND", "SNOW"], rename=True, rounded=False)
    + ") q",
    "select_observations": _with(MEASURES, STATIONS)
    + ", obs AS (SELECT date, 'TMAX' AS datatype, station, CAST(NULL AS VARCHAR) AS attributes, tmax * 10 AS value FROM measures "
    "UNION ALL SELECT date, 'TMIN', station, NULL, tmin * 10 FROM measures "
    "UNION ALL SELECT date, 'PRCP', station, NULL, prcp * 10 FROM measures)\n"
    "SELECT date, datatype, station, attributes, round(value, 6) AS value FROM ("
    "SELECT * FROM obs WHERE date >= TIMESTAMP '1996-03-01' AND date < TIMESTAMP '1997-03-01' "
    "AND datatype IN ('TMAX', 'PRCP') AND station IN (SELECT station FROM stations WHERE continent = 'EUROPE') "
    ")",
    "union_batches": _m()
    + "SELECT obs_id, date, station, round(tavg, 6) AS tavg, round(prcp, 6) AS prcp, CAST(NULL AS DOUBLE) AS humidity "
    "FROM measures UNION ALL SELECT obs_id, date, station, round(tavg, 6), NULL, round(humidity, 6) FROM measures",
    "sink_csv": _m() + EXPORT,
    "sink_json": _m() + EXPORT,
    "sink_parquet": _m()
    + "SELECT obs_id, date, year, station, round(tavg, 6) AS tavg, round(prcp, 6) AS prcp FROM measures",
    "preview": _m()
    + "SELECT obs_id, date, year, month, day, day_of_year, week, station, station_key, round(tmax, 6) AS tmax, "
    "round(tmin, 6) AS tmin, round(tavg, 6) AS tavg, round(prcp, 6) AS prcp, round(humidity, 6) AS humidity, "
    "round(wind_speed, 6) AS wind_speed, round(solar_radiation, 6) AS solar_radiation "
    "FROM measures ORDER BY date, obs_id LIMIT 10",
    # preparation
    "parse_dates": "SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN props "
    "ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS date FROM events",
    "calendar_parts": "SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, "
    "CAST(day(ts) AS INTEGER) AS day, CAST(dayofyear(ts) AS INTEGER) AS day_of_year, "
    "CAST(weekofyear(ts) AS INTEGER) AS week FROM events",
    "scale_units": _with(EV_OBS)
    + "SELECT event_id, datatype, round(CASE WHEN datatype IN ('TMAX', 'TMIN', 'TAVG', 'PRCP') "
    "THEN value / 10 ELSE value END, 6) AS value FROM ev_obs",
    "pivot_observations": _pivot(CODES, rename=False),
    "rename_codes": _pivot(CODES, rename=True),
    "derive_tavg": f"SELECT {KEYS}, round(tmax, 6) AS tmax, round(tmin, 6) AS tmin, round(prcp, 6) AS prcp, "
    "round(snow, 6) AS snow, round(wind_avg, 6) AS wind_avg, round((tmax + tmin) / 2, 6) AS tavg FROM ("
    + _pivot(PRESENT, rename=True, rounded=False)
    + ") q",
    "attach_station_attributes": _sd()
    + "SELECT obs_id, station, continent, country, round(lat, 6) AS lat, round(lon, 6) AS lon, "
    "round(elevation, 6) AS elevation FROM station_day",
    "warming_adjustment": _m()
    + "SELECT obs_id, year, round(tavg, 6) AS tavg, round(CAST(0.01 AS DOUBLE) * (year - 2000), 6) AS warming_trend, "
    "round(tavg + CAST(0.01 AS DOUBLE) * (year - 2000), 6) AS tavg_trend FROM measures",
    "coerce_numeric": "SELECT event_id, round("
    + _number("CASE WHEN event_type = 'error' THEN props ELSE CAST(value AS VARCHAR) END")
    + ", 6) AS v FROM events",
    "drop_incomplete": "SELECT * FROM ("
    + _pivot(PRESENT, rename=True)
    + ") q WHERE tmax IS NOT NULL AND tmin IS NOT NULL",
    "numeric_columns": "SELECT * FROM ("
    "SELECT 'event_id' AS \"column\", 'numeric' AS kind, count(event_id) AS n_parsable FROM events "
    "UNION ALL SELECT 'station', 'text', count(" + _number("CAST(user_id AS VARCHAR)") + ") FROM events "
    "UNION ALL SELECT 'event_type', 'text', count(" + _number("event_type") + ") FROM events "
    "UNION ALL SELECT 'props', 'text', count(" + _number("props") + ") FROM events "
    "UNION ALL SELECT 'value_text', 'text', count(" + _number("CAST(value AS VARCHAR)") + ") FROM events"
    ") t WHERE kind = 'numeric' OR n_parsable > 0",
    "fill_missing_measures": _m()
    + "SELECT obs_id, year, round(tavg, 6) AS tavg, round(prcp, 6) AS prcp, CAST(20 AS DOUBLE) AS tmax, CAST(20 AS DOUBLE) AS tmin, "
    "CAST(50 AS DOUBLE) AS humidity, CAST(5 AS DOUBLE) AS wind_speed FROM measures",
    "project_columns": _m()
    + "SELECT obs_id, date, station, round(tavg, 6) AS tavg, round(prcp, 6) AS prcp FROM measures",
    # filters and sampling
    "filter_year_range": _m()
    + "SELECT obs_id, date, year, round(tavg, 6) AS tavg FROM measures "
    "WHERE date >= TIMESTAMP '1996-01-01' AND date < TIMESTAMP '1999-01-01'",
    "filter_continent": _sd()
    + "SELECT obs_id, station, continent, round(tavg, 6) AS tavg FROM station_day WHERE continent = 'EUROPE'",
    "filter_year_set": _m()
    + "SELECT obs_id, year, round(prcp, 6) AS prcp FROM measures WHERE year IN (1995, 1999, 2001)",
    "filter_single_year": _m()
    + "SELECT obs_id, year, round(tavg, 6) AS tavg FROM measures WHERE year = (SELECT max(year) FROM measures)",
    "filter_threshold": _m() + "SELECT obs_id, round(tavg, 6) AS tavg FROM measures WHERE tavg > 20",
    "distinct_sorted": _sd()
    + "SELECT DISTINCT continent FROM station_day WHERE continent IS NOT NULL ORDER BY continent",
    "latest_years": _m()
    + "SELECT DISTINCT year FROM measures WHERE year IS NOT NULL ORDER BY year DESC LIMIT 3",
    "keep_latest_years": _m()
    + "SELECT obs_id, year, round(tavg, 6) AS tavg FROM measures WHERE year IN "
    "(SELECT DISTINCT year FROM measures WHERE year IS NOT NULL ORDER BY year DESC LIMIT 2)",
    "sample_n": _sample("orders", "o_orderkey, round(o_totalprice, 6) AS o_totalprice", "o_orderkey", 500),
    "cap_rows": _sample(
        "measures", "obs_id, round(tavg, 6) AS tavg, round(prcp, 6) AS prcp", "obs_id", 5000, _m()
    ),
    # indicators
    "row_count": "SELECT count(*) AS rows FROM lineitem",
    "kpi_summary": _m()
    + "SELECT round(avg(tavg), 6) AS tavg_mean, round(coalesce(sum(prcp), 0), 6) AS prcp_total, "
    "round(max(tmax), 6) AS tmax_max, round(min(tmin), 6) AS tmin_min, round(avg(humidity), 6) AS humidity_mean, "
    "round(avg(solar_radiation), 6) AS solar_mean, round(avg(wind_speed), 6) AS wind_mean, count(*) AS rows "
    "FROM measures HAVING count(*) > 0",
    "kpi_distinct": _sd()
    + "SELECT count(DISTINCT year) AS years, count(DISTINCT station) AS stations, "
    "count(DISTINCT continent) AS continents FROM station_day HAVING count(*) > 0",
    "kpi_heatwave": _m()
    + "SELECT round(count(*) FILTER (WHERE tmax > 30) * 100.0 / count(*), 6) AS heatwave_pct "
    "FROM measures HAVING count(*) > 0",
    "kpi_drought": _m()
    + "SELECT round(count(*) FILTER (WHERE prcp < 5) * 100.0 / count(*), 6) AS drought_pct "
    "FROM measures HAVING count(*) > 0",
    "kpi_trend": _m()
    + ", "
    + YEARLY_TREND
    + "\nSELECT round(CASE WHEN count(year) > 1 THEN coalesce(regr_slope(m, year), 0) ELSE 0 END * 100, 6) "
    "AS trend_century, round(CASE WHEN count(year) > 1 THEN coalesce(regr_slope(m, year), 0) ELSE 0 END * 10, 6) "
    "AS trend_decade FROM y",
    "kpi_variability": _m()
    + ", s AS (SELECT year, stddev_samp(tavg) AS s FROM measures WHERE year IS NOT NULL GROUP BY year)\n"
    "SELECT round(CASE WHEN count(year) > 1 THEN avg(s) ELSE 0 END, 6) AS variability FROM s",
    "kpi_dashboard": _sd()
    + ", y AS (SELECT year, avg(tavg) AS m, stddev_samp(tavg) AS s FROM measures WHERE year IS NOT NULL GROUP BY year),\n"
    "t AS (SELECT CASE WHEN count(year) > 1 THEN coalesce(regr_slope(m, year), 0) ELSE 0 END AS slope, "
    "CASE WHEN count(year) > 1 THEN avg(s) ELSE 0 END AS var, count(year) AS years FROM y)\n"
    "SELECT round(avg(tavg), 6) AS tavg_mean, round(coalesce(sum(prcp), 0), 6) AS prcp_total, "
    "round(max(tmax), 6) AS tmax_max, round(min(tmin), 6) AS tmin_min, round(avg(humidity), 6) AS humidity_mean, "
    "round(avg(solar_radiation), 6) AS solar_mean, round(avg(wind_speed), 6) AS wind_mean, count(*) AS rows, "
    "any_value(t.years) AS years, count(DISTINCT station) AS stations, count(DISTINCT continent) AS continents, "
    "round(any_value(t.slope) * 100, 6) AS trend_century, round(any_value(t.slope) * 10, 6) AS trend_decade, "
    "round(any_value(t.var), 6) AS variability, "
    "round(count(*) FILTER (WHERE tmax > 30) * 100.0 / count(*), 6) AS heatwave_pct, "
    "round(count(*) FILTER (WHERE prcp < 5) * 100.0 / count(*), 6) AS drought_pct "
    "FROM station_day, t HAVING count(*) > 0",
    # roll-ups
    "yearly_temperature": _m()
    + "SELECT year, round(avg(tavg), 6) AS tavg_mean, round(max(tmax), 6) AS tmax_max, "
    "round(min(tmin), 6) AS tmin_min FROM measures WHERE year IS NOT NULL GROUP BY year",
    "monthly_precipitation": _m()
    + ", a AS (SELECT year, month, coalesce(sum(prcp), 0) AS prcp_sum FROM measures "
    "WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month)\n"
    "SELECT year, month, round(prcp_sum, 6) AS prcp_sum, round(max(prcp_sum) OVER () * 1.1, 6) AS axis_top FROM a",
    "continent_year": _sd()
    + "SELECT year, continent, round(avg(tavg), 6) AS tavg_mean, round(max(tmax), 6) AS tmax_max, "
    "round(min(tmin), 6) AS tmin_min, round(coalesce(sum(prcp), 0), 6) AS prcp_sum, "
    "round(avg(lat), 6) AS lat_mean, round(avg(lon), 6) AS lon_mean FROM station_day "
    "WHERE year IS NOT NULL AND continent IS NOT NULL GROUP BY year, continent",
    "month_year_matrix": _m()
    + "SELECT month, year, round(avg(tavg), 6) AS tavg_mean FROM measures "
    "WHERE month IS NOT NULL AND year IS NOT NULL GROUP BY month, year HAVING avg(tavg) IS NOT NULL",
    "month_year_matrix_wide": _m()
    + "SELECT month, "
    + ", ".join(f"round(avg(tavg) FILTER (WHERE year = {y}), 6) AS \"{y}\"" for y in range(1995, 2002))
    + " FROM measures WHERE month IS NOT NULL AND year IS NOT NULL GROUP BY month",
    "monthly_stream": _m()
    + ", a AS (SELECT year, month, avg(tavg) AS tavg_mean, coalesce(sum(prcp), 0) AS prcp_sum FROM measures "
    "WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month)\n"
    "SELECT year, month, round(tavg_mean, 6) AS tavg_mean, round(prcp_sum, 6) AS prcp_sum, "
    "round(sum(tavg_mean) OVER (PARTITION BY month ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) "
    "AS tavg_stack FROM a",
    "seasonal_profile": _m()
    + "SELECT month, round(avg(tavg), 6) AS tavg_mean FROM measures WHERE month IS NOT NULL GROUP BY month",
    "yearly_mean": _m()
    + "SELECT year, round(avg(tavg), 6) AS tavg_mean FROM measures WHERE year IS NOT NULL GROUP BY year",
    "resample_mean": _resample("M"),
    "resample_mean_d": _resample("D"),
    "resample_mean_w": _resample("W"),
    "resample_mean_q": _resample("Q"),
    "resample_mean_y": _resample("Y"),
    "date_span": _m()
    + "SELECT min(date) AS first_date, max(date) AS last_date, "
    "CAST(date_diff('day', min(date), max(date)) AS BIGINT) AS days FROM measures",
    "stacked_totals": _sd()
    + "SELECT year, continent, round(coalesce(sum(prcp), 0), 6) AS prcp_sum FROM station_day "
    "WHERE year IS NOT NULL AND continent IS NOT NULL GROUP BY year, continent",
    # bins and grids
    "histogram": _m() + ", v AS (SELECT tavg AS v FROM measures WHERE tavg IS NOT NULL),\n" + _histogram(100),
    "histogram_infinite": _m() + f", v AS (SELECT tavg AS v FROM measures WHERE tavg IS NOT NULL AND {FINITE}),\n" + _histogram(10),
    "infinite_values": _m() + "SELECT count(*) FILTER (humidity = 30) AS below, count(*) FILTER (humidity = 31) AS above FROM measures",
    "density_2d_infinite": _m()
    + f", p AS (SELECT tavg, humidity FROM measures WHERE tavg IS NOT NULL AND humidity IS NOT NULL AND {FINITE})\n"
    + _grid("p", "tavg", "humidity", 20, 20, "count(*) AS n"),
    "grid_mean": _sd()
    + ", p AS (SELECT lon, lat, tavg FROM station_day WHERE lon IS NOT NULL AND lat IS NOT NULL AND tavg IS NOT NULL)\n"
    + _grid("p", "lon", "lat", 800, 400, "round(avg(tavg), 6) AS tavg_mean"),
    "grid_map": _sd()
    + ", p AS (SELECT lon, lat, tavg FROM station_day WHERE lon IS NOT NULL AND lat IS NOT NULL)\n"
    + "SELECT * FROM ("
    + _grid("p", "lon", "lat", 800, 600, "round(avg(tavg), 6) AS tavg_mean")
    + ") g WHERE tavg_mean IS NOT NULL",
    "grid_xy": _m()
    + ", p AS (SELECT tavg, prcp, year FROM measures WHERE tavg IS NOT NULL AND prcp IS NOT NULL)\n"
    "SELECT * FROM ("
    + _grid("p", "tavg", "prcp", 800, 500, "round(avg(year), 6) AS year_mean")
    + ") g WHERE year_mean IS NOT NULL",
    "grid_series": _m()
    + ", p AS (SELECT epoch_us(date) AS x, tavg FROM measures WHERE date IS NOT NULL AND tavg IS NOT NULL)\n"
    + _grid("p", "x", "tavg", 800, 400, "count(*) AS n"),
    "density_2d": _m()
    + ", p AS (SELECT tavg, humidity FROM measures WHERE tavg IS NOT NULL AND humidity IS NOT NULL)\n"
    + _grid("p", "tavg", "humidity", 20, 20, "count(*) AS n"),
    "box_stats": "WITH " + _box("events", "value", "event_type"),
    "violin_density": _sd()
    + ", p AS (SELECT continent, tavg AS v FROM station_day WHERE continent IS NOT NULL AND tavg IS NOT NULL),\n"
    "e AS (SELECT min(v) AS lo, max(v) AS hi FROM p),\n"
    f"c AS (SELECT continent, {_bin('v', 'lo', 'hi', 50)} AS bin, any_value(lo) AS lo, any_value(hi) AS hi, "
    "count(*) AS n FROM p, e GROUP BY 1, 2),\n"
    "t AS (SELECT continent, count(*) AS t FROM p GROUP BY 1)\n"
    "SELECT c.continent, bin, round(lo + bin * (hi - lo) / 50.0, 6) AS lo, round(lo + (bin + 1) * (hi - lo) / 50.0, 6) AS hi, "
    "round(n / t, 6) AS density FROM c JOIN t ON c.continent = t.continent",
    # statistics
    "describe": _m() + _describe(["tavg", "prcp", "tmax"]),
    "describe_all": _m()
    + _describe(["year", "month", "day", "day_of_year", "week", "tmax", "tmin", "tavg", "prcp", "humidity", "wind_speed", "solar_radiation"]),
    "correlation_matrix": _corr(),
    "linear_trend": _m()
    + ", "
    + YEARLY_TREND
    + ",\nf AS (SELECT regr_slope(m, year) AS slope, regr_intercept(m, year) AS intercept, "
    "covar_samp(CAST(year AS DOUBLE), m) / NULLIF(stddev_samp(CAST(year AS DOUBLE)) * stddev_samp(m), 0) AS r, "
    "count(m) AS years FROM y)\n"
    "SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r, round(r * r, 6) AS r2, "
    "round(slope * 10, 6) AS slope_decade, years FROM f WHERE years > 1",
    "trend_line": _m()
    + ", "
    + YEARLY_TREND
    + ",\nf AS (SELECT regr_slope(m, year) AS slope, regr_intercept(m, year) AS intercept, count(m) AS years FROM y)\n"
    "SELECT year, round(m, 6) AS tavg_mean, round(intercept + slope * year, 6) AS fitted FROM y, f WHERE years > 1",
    # profiles
    "year_profile": _profile("year = (SELECT max(year) FROM measures)"),
    "reference_profile": _profile(None),
    "compare_years": _profile("year IN (1996, 2000)"),
    # chart feeds
    "parallel_coordinates": _m() + f"SELECT {PARALLEL} FROM measures",
    "parallel_coordinates_sample": _sample("measures", PARALLEL, "obs_id", 500, _m()),
    "parallel_coordinates_years": _m()
    + "SELECT round(tavg, 6) AS tavg, round(tmax, 6) AS tmax, round(tmin, 6) AS tmin, round(prcp, 6) AS prcp, "
    "round(humidity, 6) AS humidity, round(wind_speed, 6) AS wind_speed, year FROM measures WHERE year IN (1997, 2000)",
    "grid_xy_category": _m()
    + ", p AS (SELECT tavg, prcp, station FROM measures WHERE tavg IS NOT NULL AND prcp IS NOT NULL)\n"
    "SELECT * FROM ("
    + _grid("p", "tavg", "prcp", 800, 500, "station, count(*) AS n").replace("GROUP BY 1, 2", "GROUP BY 1, 2, station")
    + ") g WHERE station IS NOT NULL",
    "scatter_3d": _sd() + f"SELECT {SCATTER} FROM station_day",
    "scatter_3d_sample": _sample("station_day", SCATTER, "obs_id", 5000, _sd()),
    "scatter_points": _m()
    + "SELECT round(tavg, 6) AS tavg, round(prcp, 6) AS prcp, year, date, station FROM measures",
    "frame_rows": _sd()
    + "SELECT continent, month, round(tavg, 6) AS tavg FROM station_day WHERE continent IS NOT NULL AND month IS NOT NULL",
    "frames": _sd()
    + "SELECT continent, month, round(avg(tavg), 6) AS tavg_mean FROM station_day "
    "WHERE continent IS NOT NULL AND month IS NOT NULL GROUP BY continent, month",
    "log_axis": _m()
    + "SELECT round(log10(prcp), 6) AS log10_prcp, round(log10(humidity), 6) AS log10_humidity "
    "FROM measures WHERE prcp > 0 AND humidity > 0",
    "scatter_sample": _sample(
        "measures", "round(tavg, 6) AS tavg, round(prcp, 6) AS prcp, year, date, station", "obs_id", 10000, _m()
    ),
    # report
    "report_yearly": _m()
    + "SELECT year, count(*) AS rows, round(avg(tavg), 6) AS temp_mean, round(coalesce(sum(prcp), 0), 6) AS prcp_sum, "
    "round(avg(tmax), 6) AS temp_max, round(avg(tmin), 6) AS temp_min FROM measures WHERE year IS NOT NULL "
    "GROUP BY year",
    "report_monthly": _m()
    + "SELECT month, count(*) AS rows, round(avg(tavg), 6) AS temp_mean, round(avg(prcp), 6) AS prcp_mean, "
    "round(coalesce(sum(prcp), 0), 6) AS prcp_sum, round(avg(tmax), 6) AS temp_max, "
    "round(avg(tmin), 6) AS temp_min FROM measures WHERE month IS NOT NULL GROUP BY month",
    "report_station": _m()
    + "SELECT station, count(*) AS rows, count(DISTINCT year) AS years, round(avg(tavg), 6) AS temp_mean, "
    "round(coalesce(sum(prcp), 0), 6) AS prcp_sum, round(avg(prcp), 6) AS prcp_mean FROM measures "
    "WHERE station IS NOT NULL GROUP BY station",
    "report_station_counts": _m()
    + "SELECT station, count(*) AS rows FROM measures WHERE station IS NOT NULL GROUP BY station",
    "report_header": _m()
    + ", "
    + YEARLY_TREND
    + ",\nt AS (SELECT CASE WHEN count(year) > 1 THEN coalesce(regr_slope(m, year), 0) ELSE 0 END * 100 AS tc FROM y)\n"
    "SELECT min(year) AS first_year, max(year) AS last_year, round(avg(tavg), 6) AS temp_mean, "
    "round(coalesce(sum(prcp), 0), 6) AS prcp_sum, count(*) FILTER (WHERE prcp > 0) AS rainy_days, "
    "count(*) AS rows, count(DISTINCT station) AS stations, round(any_value(t.tc), 6) AS trend_century "
    "FROM measures, t HAVING count(*) > 0",
    "report_stability": _m()
    + "SELECT round(stddev_samp(tavg), 6) AS temp_std, count(DISTINCT year) AS years FROM measures",
    "flag_extremes": _m()
    + ", a AS (SELECT year, avg(tavg) AS temp_mean FROM measures WHERE year IS NOT NULL GROUP BY year)\n"
    "SELECT year, round(temp_mean, 6) AS temp_mean, temp_mean = max(temp_mean) OVER () AS temp_mean_is_max, "
    "temp_mean = min(temp_mean) OVER () AS temp_mean_is_min FROM a",
}
SQL["violin_density_by_month"] = (
    _sd()
    + ", p AS (SELECT month, continent, tavg AS v FROM station_day WHERE continent IS NOT NULL AND tavg IS NOT NULL AND month IS NOT NULL),\n"
    "e AS (SELECT min(tavg) AS lo, max(tavg) AS hi FROM measures WHERE month IS NOT NULL AND station_key IS NOT NULL),\n"
    f"c AS (SELECT month, continent, {_bin('v', 'lo', 'hi', 20)} AS bin, any_value(lo) AS lo, any_value(hi) AS hi, "
    "count(*) AS n FROM p, e GROUP BY 1, 2, 3),\n"
    "t AS (SELECT month, continent, count(*) AS t FROM p GROUP BY 1, 2)\n"
    "SELECT c.month, c.continent, bin, round(lo + bin * (hi - lo) / 20.0, 6) AS lo, round(lo + (bin + 1) * (hi - lo) / 20.0, 6) AS hi, "
    "round(n / t, 6) AS density FROM c JOIN t ON c.continent = t.continent AND c.month = t.month"
)
SQL["select_observations_limit"] = (
    _with(MEASURES) + ", " + OBS + "SELECT date, datatype, station, attributes, round(value, 6) AS value FROM ("
    "SELECT * FROM obs WHERE date >= TIMESTAMP '1996-03-01' AND date < TIMESTAMP '1997-03-01' AND datatype IN ('TMAX', 'PRCP') "
    "ORDER BY date, station, datatype, value LIMIT 1000)"
)
SQL["select_observations_dataset"] = (
    _with(MEASURES) + ", " + OBS + "SELECT date, datatype, station, attributes, round(value, 6) AS value, 'MONTHLY' AS dataset "
    "FROM obs WHERE date >= TIMESTAMP '1995-01-01' AND date < TIMESTAMP '2002-01-01' AND datatype = 'PRCP'"
)
SQL["prepare_feed_default"] = (
    f"SELECT {KEYS}, round(tmax, 6) AS tmax, round(tmin, 6) AS tmin, round(prcp, 6) AS prcp, round(snow, 6) AS snow, "
    "round(wind_avg, 6) AS wind_avg, round((tmax + tmin) / 2, 6) AS tavg, continent, round(lat, 6) AS lat, "
    "round(CAST(0.01 AS DOUBLE) * (year - 2000), 6) AS warming_trend, "
    "round((tmax + tmin) / 2 + CAST(0.01 AS DOUBLE) * (year - 2000), 6) AS tavg_trend FROM ("
    + _pivot(["TMAX", "TMIN", "PRCP", "SNOW", "AWND"], rename=True, rounded=False)
    + ") q LEFT JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS sid, r_name AS continent, CAST((s_suppkey * 37) % 181 - 90 AS DOUBLE) AS lat "
    "FROM supplier LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) g ON s_nationkey = g.n_nationkey) st "
    "ON q.station = st.sid"
)
SQL["columns_by_type"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(*) AS rows FROM events"
    for c, k in {"event_id": "number", "ts": "time", "user_id": "number", "event_type": "text", "value": "number", "props": "text"}.items()
)
SQL["box_stats_by_station"] = _m() + ", " + _box("measures", "tavg", "station")
SQL["sample_fraction"] = (
    "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders "
    f"WHERE substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 15) < '{round(0.1 * 16**15):015x}'"
)
SQL["curate_station_day"] = SQL["prepare_feed"]
SQL["cap_rows_massive"] = _sample(
    "measures", "obs_id, round(tavg, 6) AS tavg, round(prcp, 6) AS prcp", "obs_id", 500000, _m()
)

# Time columns of the registered outputs are compared as ISO text (see
# ``catalog.finish``); DuckDB prints timestamps in the same format.
TIME_TEXT_COLUMNS = {
    "unnest_results": ["date"], "stream_ingest": ["date"], "curate_station_day": ["date"],
    "prepare_feed": ["date"], "select_observations": ["date"], "union_batches": ["date"],
    "sink_parquet": ["date"], "preview": ["date"], "parse_dates": ["date"],
    "pivot_observations": ["date"], "rename_codes": ["date"], "derive_tavg": ["date"],
    "drop_incomplete": ["date"], "project_columns": ["date"], "filter_year_range": ["date"],
    "resample_mean": ["period"], "resample_mean_d": ["period"], "resample_mean_w": ["period"],
    "resample_mean_q": ["period"], "resample_mean_y": ["period"],
    "date_span": ["first_date", "last_date"], "scatter_sample": ["date"], "scatter_points": ["date"],
    "select_observations_limit": ["date"], "select_observations_dataset": ["date"], "prepare_feed_default": ["date"],
}
for _key, _cols in TIME_TEXT_COLUMNS.items():
    _casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _cols)
    SQL[_key] = f"SELECT * REPLACE ({_casts}) FROM (\n{SQL[_key]}\n) AS q"
