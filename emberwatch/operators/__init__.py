"""Detection, scoring, correlation, graph and intelligence operators on event DataFrames."""
