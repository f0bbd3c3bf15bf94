"""DataFrame operators: filters, joins, matching, aggregates, dedup, checks."""
