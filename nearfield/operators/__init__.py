"""Operators over notes, the vector index and the work queue."""
