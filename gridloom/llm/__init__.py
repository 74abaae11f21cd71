"""Training-data operators: dedup, packing, scans, scoring, search and archives.

Nothing outside this subpackage imports it.
"""
