"""Structured Streaming versions of counting, deduplication and burden windows."""
