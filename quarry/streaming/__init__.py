"""Incremental and stateful operators on Structured Streaming."""
