"""Training-data operators: quality rules, dedup, mixing, tokenization, search and formatting.

Nothing outside this subpackage imports it.
"""
