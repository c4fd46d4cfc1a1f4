"""The operators as table functions of ``spark.sql``.

``register_functions`` gives a session temporary table functions over one table of station-days and one of stations::

    register_functions(spark, days, stations)
    spark.sql("SELECT * FROM climate_continent_year(1994, 1996) WHERE continent = 'ASIA'")

Every function is a Spark SQL function whose body selects from the operator's lazy result, so a call is planned together
with the query around it. Years and continents are keys of the operators that take them: choosing them after grouping
equals choosing them before, and Catalyst moves the choice below the aggregation. Operators that measure their
input before they plan (quantiles, correlations, fitted bins) have no function: each call would be a scan at registration.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from climatrix.operators import kpi, prepare, rollup

PREFIX = "climate_"


@dataclass(frozen=True)
class Function:
    """A table function: the operator, its parameters (name, type) and the condition that they put on its rows."""

    operator: Callable[[DataFrame, DataFrame], DataFrame]
    parameters: tuple[tuple[str, str], ...] = ()
    condition: str = "true"


_YEARS = (("first_year", "INT"), ("last_year", "INT"))
_IN_YEARS = "year BETWEEN first_year AND last_year"

FUNCTIONS: dict[str, Function] = {
    "days": Function(lambda d, s: d, _YEARS, _IN_YEARS),
    "days_at": Function(prepare.attach_station_attributes, (*_YEARS, ("of_continent", "STRING")), f"{_IN_YEARS} AND (of_continent IS NULL OR continent = of_continent)"),
    "warm_days": Function(lambda d, s: d, (("above", "DOUBLE"), *_YEARS), f"tavg > above AND {_IN_YEARS}"),
    "yearly_temperature": Function(lambda d, s: rollup.yearly_temperature(d), _YEARS, _IN_YEARS),
    "yearly_mean": Function(lambda d, s: rollup.yearly_mean(d), _YEARS, _IN_YEARS),
    "continent_year": Function(rollup.continent_year, _YEARS, _IN_YEARS),
    "summary": Function(lambda d, s: kpi.kpi_summary(d)),
    "dashboard": Function(kpi.kpi_dashboard),
}


def register_functions(spark: SparkSession, days: DataFrame, stations: DataFrame, prefix: str = PREFIX) -> list[str]:
    """Create (or replace) a temporary table function per entry of ``FUNCTIONS``; their names.

    A function's rows come from a temporary view of the same name. A null bound of a range of years selects no rows, as in
    SQL; a null continent selects all. Nothing is read until a function is called.
    """
    names = []
    for name, f in FUNCTIONS.items():
        out = f.operator(days, stations)
        view = f"{prefix}{name}"
        out.createOrReplaceTempView(view)
        columns = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in out.schema)
        parameters = ", ".join(f"{p} {kind}" for p, kind in f.parameters)
        chosen = ", ".join(f"`{c}`" for c in out.columns)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {view}({parameters}) RETURNS TABLE ({columns}) RETURN SELECT {chosen} FROM {view} WHERE {f.condition}")
        names.append(view)
    return names
