"""Log ingestion, search and time-bucketed counting as Spark jobs."""
