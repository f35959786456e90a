"""Continuous capture ingestion with Structured Streaming."""
