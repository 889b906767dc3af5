"""Column functions: expressions in, expressions out, no jobs."""
