"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every module holds one operator
with a general interface; ``registry`` holds the thin ``opN_*`` queries.
"""
