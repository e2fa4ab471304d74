"""Queries over the standard tables, each beside the SQL that gives the same rows."""
