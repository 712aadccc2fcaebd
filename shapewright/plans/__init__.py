"""Report jobs composed of the operators, and the queries that run them on the given tables."""
