"""Operators of a training-data pipeline: sharding, search, scans, filters, classifiers, dedup, packing, chat formatting."""
