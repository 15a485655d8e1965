"""Training-data operators: packing, fingerprints, BPE, URL filter, WARC, deduplication, quality.

Nothing outside this subpackage imports it.  ``queries`` registers one thin
query for each operator.
"""
