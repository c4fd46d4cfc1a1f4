"""climatrix: climate-observation analytics as Spark DataFrame operators.

Sub-packages: ``sources`` (landed feed, selection, sinks, fixture adapter),
``operators`` (preparation, filters, sampling, aggregations, binning,
statistics, profiles, chart feeds, report tables), ``functions`` (column
expressions), ``plans`` (registered queries and their DuckDB twins) and
``streaming`` (incremental landing of feed pages).
"""

__version__ = "0.1.0"
