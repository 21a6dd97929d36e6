"""Operators of a training-data pipeline: fingerprints, deduplication, extraction, scoring, mixing, encoding, sharding."""
