"""Column expressions: each takes and returns Spark columns."""
