"""Structured Streaming entry points: incremental landing of feed pages, and the current value of every key."""

from climatrix.streaming.ingest import feed_stream, land_observations
from climatrix.streaming.versions import current_observations, dead_letters, keep_current, land_versions, landed_observations, latest_observations, overdue_records

__all__ = [
    "current_observations",
    "dead_letters",
    "feed_stream",
    "keep_current",
    "land_observations",
    "land_versions",
    "landed_observations",
    "latest_observations",
    "overdue_records",
]
