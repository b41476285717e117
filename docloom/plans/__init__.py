"""Queries of the reference's own operators and the SQL they are checked against."""
