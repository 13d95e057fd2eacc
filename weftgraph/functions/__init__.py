"""Column expressions, vocabularies and table functions."""
