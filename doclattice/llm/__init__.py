"""Training-data operators: deduplication, tokens, filters and scans over `documents`.

Every operator takes and returns DataFrames. Nothing outside this subpackage imports it.
"""
