"""Column expressions: tagged text, context vectors and similarity."""
