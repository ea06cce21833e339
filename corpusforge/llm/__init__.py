"""Training-data operators: deduplication, filtering, mixing and decontamination.

Nothing outside this subpackage imports it.
"""
