"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage. ``queries`` holds the
thin queries with their fixed result columns; the other modules hold the
operators with their own, more general interfaces.
"""
