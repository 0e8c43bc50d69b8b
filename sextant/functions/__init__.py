"""Column expressions and small numerics."""
