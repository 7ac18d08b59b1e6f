"""Column functions: everything here stays inside Spark's own expressions."""
