"""Relational operators: frames in, frames out, nothing collected."""
