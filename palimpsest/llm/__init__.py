"""Training-data operators: deduplication, decontamination, extraction, scoring and encoding.

Nothing outside this subpackage imports it.
"""
