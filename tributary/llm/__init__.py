"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; ``queries.py`` registers the
contract queries and ``common.py`` holds what the operators share.
"""
