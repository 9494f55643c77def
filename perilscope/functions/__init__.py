"""Column expressions: no jobs, no joins."""
