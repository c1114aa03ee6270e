"""Similarity search over embedding columns, on Spark's own DataFrame and SQL operators."""
