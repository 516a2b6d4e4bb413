"""Operators for building training corpora: ten Spark jobs over whole texts."""
