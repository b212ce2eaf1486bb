"""Indexing and searching collections of court decisions on Spark."""
