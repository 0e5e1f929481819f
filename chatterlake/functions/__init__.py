"""Column expressions: ids, text, scores, classes."""
