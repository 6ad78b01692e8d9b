"""trawl: occurrence search and corpus preparation as Spark jobs."""
