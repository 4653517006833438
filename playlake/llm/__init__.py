"""Operators for training-data pipelines: search, filters, de-duplication, quality, mixing."""
