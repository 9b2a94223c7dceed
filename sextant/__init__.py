"""sextant: point-in-time ranking and evaluation of panel data on Spark DataFrames."""
