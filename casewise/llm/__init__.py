"""Operators of a training-data pipeline: scoring, deduplication, decontamination, mixing, extraction and token files."""
