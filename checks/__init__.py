"""SQL forms of the queries, for comparison in another engine."""
