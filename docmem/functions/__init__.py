"""Column expressions: JSON text, document paths, vectors."""
