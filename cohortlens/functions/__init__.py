"""Column functions: typed facts, conditions, verdicts."""
