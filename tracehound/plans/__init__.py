"""Ready-made jobs, table views and the query catalogue."""
