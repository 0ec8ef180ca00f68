"""Training-data operators: scoring, counting, formatting, mixing, encoding and deduplication.

Nothing outside this subpackage imports it.
"""
