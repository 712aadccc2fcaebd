"""DataFrame operators: filters, joins, aggregates, ranks, recursion and change handling."""
