"""Road-segment incident-risk analytics written as Spark DataFrame jobs."""
