"""Structured Streaming variants of the batch loads."""
