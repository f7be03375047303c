"""Operators for large-scale training-data work; nothing outside this subpackage imports it."""
