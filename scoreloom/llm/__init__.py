"""Training-data operators: deduplication, tokenizing, mixing, extraction, search, sharding, filtering.

Nothing outside this subpackage imports it.  ``registry`` lists its queries and their SQL.
"""
