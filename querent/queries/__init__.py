"""Registered queries: each module has QUERIES and SQL, by name."""
