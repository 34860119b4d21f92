"""Training-data operators: sharding, deduplication, scans and packing of text corpora.

Nothing else in the package imports this subpackage. ``queries.py`` registers
one query for each operator, ``oracles.py`` holds the SQL that checks them.
"""
