"""Plan nodes: extraction, partial aggregation, merging, filters and queries, each a DataFrame to DataFrame function."""
