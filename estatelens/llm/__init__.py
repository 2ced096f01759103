"""Operators for large-scale training-data preparation, and their queries."""
