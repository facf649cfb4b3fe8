"""Operators for training-data pipelines.

Nothing else in the library imports this package.  Each module holds one
operator with its general interface; ``queries`` holds the thin registered
queries and their digests.
"""
