"""Operators of a training-data pipeline: counting, de-duplication, encoding, scoring, packing, mixing, formatting."""
