"""Operators for preparing language-model training data.

Each module holds one operator with a general interface; ``queries`` binds them
to the driver tables. Nothing outside this subpackage imports it.
"""
