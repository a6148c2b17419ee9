"""Continuous ingestion: the same change detection, driven by Structured Streaming."""
