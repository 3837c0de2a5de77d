"""Queries over the given tables, one per operator, with the SQL they must agree with."""
