"""Operators of a training-data pipeline: deduplication, packing, sharding, tokenising, extraction, auditing.

Nothing else in the library imports this subpackage.
"""
