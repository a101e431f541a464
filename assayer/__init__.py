"""Evidence and verdict analytics as plain Spark DataFrame jobs."""
