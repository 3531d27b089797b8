"""Operators of a training-data pipeline: language, toxicity, dedup, search, packing, counting."""
