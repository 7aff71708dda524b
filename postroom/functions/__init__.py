"""Scalar functions, Column to Column.

All of them are built-in expressions, so they stay inside code generation and
Catalyst can prune and push them.  White space is Unicode white space.
"""
