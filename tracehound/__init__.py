"""Security-log analytics and file-timeline checks, expressed as Spark DataFrame jobs."""
