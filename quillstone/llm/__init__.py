"""Operators for large training-data pipelines; nothing outside imports this subpackage."""
