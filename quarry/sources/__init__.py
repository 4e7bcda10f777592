"""Readers, writers and parsers."""
