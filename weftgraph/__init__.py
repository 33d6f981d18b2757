"""Service-graph analytics over DataFrames."""
