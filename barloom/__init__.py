"""barloom: bars, windows, as-of joins and path simulation on Spark DataFrames."""
