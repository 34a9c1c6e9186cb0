"""The catalog of queries with their SQL."""
