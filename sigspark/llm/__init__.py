"""Operators for training-data pipelines: dedup, decontamination, tokenisation, extraction, search."""
