"""Operators for building language-model training data: scoring, deduplication, mixing, packing and output."""
