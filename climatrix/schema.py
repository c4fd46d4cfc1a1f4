"""Schemas, code maps and defaults of the climate-observation data model.

Two table shapes exist: long observations (one row per date x station x
datatype) and the wide station-day table (one row per date x station).
Station attributes live in their own dimension table and are joined in
only when a query needs them.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results).
# ---------------------------------------------------------------------------

# Feed datatype code -> wide column name.
CODE_TO_COLUMN = {
    "TMAX": "tmax",
    "TMIN": "tmin",
    "TAVG": "tavg",
    "PRCP": "prcp",
    "SNOW": "snow",
    "SNWD": "snow_depth",
    "AWND": "wind_avg",
    "WSF2": "wind_fastest",
    "WDF2": "wind_direction",
    "WSF5": "wind_gust",
}

# Feed values in tenths: temperatures and precipitation are divided by 10.
TENTHS_CODES = ("TMAX", "TMIN", "TAVG", "PRCP")
TENTHS_DIVISOR = 10.0

# Constants used for absent measure columns (year profile).
MEASURE_DEFAULTS = {
    "tavg": 20.0,
    "tmax": 20.0,
    "tmin": 20.0,
    "prcp": 0.0,
    "humidity": 50.0,
    "wind_speed": 5.0,
}

# The six measures of the year profile, in display order, and the extra
# divisor applied to the shown value after 0-1 scaling.
PROFILE_MEASURES = ("tavg", "tmax", "tmin", "prcp", "humidity", "wind_speed")
PROFILE_SHOWN_DIVISOR = {"prcp": 100.0, "humidity": 100.0, "wind_speed": 20.0}

# Indicator thresholds: heat day is tmax > 30, dry day is prcp < 5 (strict).
HEAT_THRESHOLD = 30.0
DRY_THRESHOLD = 5.0
# Defaults of indicators whose source column is absent.
KPI_ABSENT_DEFAULTS = {"humidity_mean": 65.0, "continents": 1}
# Warming adjustment: 0.01 degree per year after 2000.
WARMING_PER_YEAR = 0.01
WARMING_BASE_YEAR = 2000
# Benchmark-page filter: tavg > 20.
WARM_DAY_THRESHOLD = 20.0

# Resample frequencies accepted by resample_mean.
FREQUENCIES = ("D", "W", "M", "Q", "Y")

# Grid sizes (width x height) of the three raster views.
GRID_MAP = (800, 600)
GRID_SCATTER = (800, 500)
GRID_SPATIAL = (800, 400)

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

CALENDAR_COLUMNS = ("year", "month", "day", "day_of_year", "week")
# Landed API page: {"results": [ {date, datatype, station, attributes, value}, ... ]}
# Dates arrive as text; they are parsed by parse_dates.
FEED_RECORD = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("datatype", T.StringType()),
        T.StructField("station", T.StringType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
FEED_PAGE = T.StructType([T.StructField("results", T.ArrayType(FEED_RECORD))])
