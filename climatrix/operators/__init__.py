"""DataFrame -> DataFrame operators over the station-day model."""
