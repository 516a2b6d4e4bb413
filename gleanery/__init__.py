"""Corpus and learning analytics as Spark jobs."""
