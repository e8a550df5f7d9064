"""Social-feed analytics expressed as Spark DataFrame jobs."""
