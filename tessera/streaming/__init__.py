"""Incremental refresh and Structured Streaming jobs."""
