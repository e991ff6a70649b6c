"""Structured Streaming forms: ingest with upserts, exact trailing rate limits, late items."""
