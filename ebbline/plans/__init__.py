"""Registered queries on the given tables and equal SQL."""
