"""Column-building functions and SQL functions."""
