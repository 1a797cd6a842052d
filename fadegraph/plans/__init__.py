"""Operators chained into ingest, search and maintenance."""
