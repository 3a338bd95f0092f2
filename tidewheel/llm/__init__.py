"""Operators for building training data out of text tables.

Nothing else in the library imports this subpackage."""
