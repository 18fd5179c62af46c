"""Order and delivery analytics expressed as Spark DataFrame jobs."""
