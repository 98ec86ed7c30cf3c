"""Operators for large training-data pipelines: deduplication, scoring, mixing, packing, archives.

Nothing outside this subpackage imports it.
"""
