"""DataFrame operators. Each takes and returns DataFrames and adds no action."""
