"""DataFrame operators: each takes DataFrames and returns a DataFrame, with no action inside."""
