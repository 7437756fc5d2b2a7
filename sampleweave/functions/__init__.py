"""Column expressions: numbers, text and vectors."""
