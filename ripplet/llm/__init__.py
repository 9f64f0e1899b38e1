"""Training-data operators: deduplication, classifiers, scans, packing, sharding.

Nothing outside this subpackage imports it.
"""
