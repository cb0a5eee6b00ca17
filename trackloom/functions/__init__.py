"""Column functions: geometry, vectors, text."""
