"""DataFrame operators: joins, aggregations, windows, estimators, decisions."""
