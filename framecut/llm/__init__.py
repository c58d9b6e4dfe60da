"""Operators that prepare text for language-model training.

Each module holds one operator with a general interface; ``queries`` wraps
them into the fixed-contract queries.  Nothing outside this package imports it.
"""
