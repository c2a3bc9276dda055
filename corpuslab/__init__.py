"""Corpus and retrieval analytics on Spark."""
