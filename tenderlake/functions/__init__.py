"""Column builders and vectorised functions."""
