"""Jobs composed of operators, and the query catalogue."""
