"""Market-data and corpus analytics as Spark DataFrame jobs."""
