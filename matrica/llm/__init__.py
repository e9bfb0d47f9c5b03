"""Operators for large text and training-data collections. Nothing else in the library imports this subpackage."""
