"""Column functions and the small numeric helpers that Spark has no built-in for."""
