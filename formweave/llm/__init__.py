"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  ``catalog`` registers the queries
of the ten operators and of the corpus pipeline.
"""
