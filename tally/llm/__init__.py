"""Training-data operators: quality filters, deduplication, packing and token files.

Nothing outside this subpackage imports it.
"""
