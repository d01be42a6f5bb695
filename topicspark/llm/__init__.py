"""Operators for large-scale training-data pipelines; nothing outside imports this package."""
