"""Column functions: statistics, names, intervals."""
