"""DataFrame to DataFrame operators: joins, dedup, top-k, matching, hooks."""
