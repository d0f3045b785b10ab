"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each operator lives in a
module of its own; ``queries`` holds the thin digest queries and their SQL.
"""
