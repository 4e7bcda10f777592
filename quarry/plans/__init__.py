"""Whole plans and the queries that bind operators to the driver tables."""
