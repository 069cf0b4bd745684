"""Training-data operators: deduplication, extraction, tokenising, search and filtering.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
