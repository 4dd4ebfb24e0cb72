"""Commerce and identity analytics as Spark DataFrame jobs."""
