"""tabforge: synthetic tabular data made and checked with Spark."""
