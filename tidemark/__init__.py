"""Ordinal score analytics on Spark."""
