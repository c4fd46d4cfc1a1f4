"""Column-expression helpers (built-in Spark functions only)."""

from climatrix.functions.binning import bin_edge, bin_index, bin_lower, bin_upper, edge_bin
from climatrix.functions.calendar import calendar_columns, epoch_micros, period_calendar, period_label
from climatrix.functions.safe import nan_free, nan_to_null, pair_corr, share_pct, sum0, to_number

__all__ = [
    "bin_edge",
    "bin_index",
    "bin_lower",
    "bin_upper",
    "calendar_columns",
    "edge_bin",
    "epoch_micros",
    "nan_free",
    "nan_to_null",
    "pair_corr",
    "period_calendar",
    "period_label",
    "share_pct",
    "sum0",
    "to_number",
]
