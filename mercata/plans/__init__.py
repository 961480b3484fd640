"""Composed jobs (one module per analysis family) and the query registry."""
