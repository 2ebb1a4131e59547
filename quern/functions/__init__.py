"""Column expressions: numbers, spatial, text, vectors."""
