"""Structured Streaming: log ingestion and change feeds."""
