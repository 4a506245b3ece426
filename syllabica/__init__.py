"""Curriculum catalogues and the documents written against them, on Spark."""
