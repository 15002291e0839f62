"""Registered queries: carriers over the given tables, one query per operator, and their SQL twins."""
