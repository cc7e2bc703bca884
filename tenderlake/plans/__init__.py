"""Compositions of operators: packages, extraction, analysis, reports, and the query catalogue."""
