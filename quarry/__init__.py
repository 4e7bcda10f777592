"""Quarry: retrieval and analytics over filing collections, as Spark plans."""

__version__ = "0.1.0"
