"""Column expressions and embedders."""
