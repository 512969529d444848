"""Column expressions and exact statistics."""
