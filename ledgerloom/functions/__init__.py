"""Column expressions: no joins, no actions."""
