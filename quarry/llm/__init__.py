"""Training-data operators: deduplication, filtering, mixing, media and tokenizing.

Nothing outside this subpackage imports it.
"""
