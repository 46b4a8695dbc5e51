"""Operators of a training-data pipeline (tokenizing, filtering, dedup, search, mixing).

Nothing else in the library imports this subpackage.
"""
