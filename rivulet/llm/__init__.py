"""Operators for preparing large text corpora: search, dedup, filters, mixing, sharding.

Nothing else in the library imports this subpackage; it stands alone.
"""
