"""Operators that prepare training text: deduplication, filtering, tokens, archives, shards, search.

Nothing outside this subpackage imports it. Every operator takes and returns data frames.
"""
