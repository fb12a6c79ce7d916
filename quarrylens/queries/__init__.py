"""Registered queries of the core: each module has QUERIES and SQL."""
