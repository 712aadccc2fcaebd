"""Column expressions with the dialect's rules for NULL, rounding, padding and dates. No Python UDFs."""
