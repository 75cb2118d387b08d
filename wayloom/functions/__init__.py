"""Column functions; each runs inside Spark's own expressions."""
