"""Operators of a training-data pipeline: tokenising, dedup, scoring, packing."""
