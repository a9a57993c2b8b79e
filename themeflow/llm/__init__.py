"""Operators for building training data: packing, deduplication, filtering, scanning, scoring."""
