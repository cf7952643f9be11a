"""Operators of a training-data pipeline: cleaning, deduplication, mixing and packing of documents."""
