"""Column expressions and Arrow batch helpers."""
