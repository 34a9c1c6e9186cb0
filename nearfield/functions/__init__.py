"""Column expressions for text and vectors."""
