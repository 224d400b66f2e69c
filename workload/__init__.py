"""Queries over the test tables, with the same queries in plain SQL."""
