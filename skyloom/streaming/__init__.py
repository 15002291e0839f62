"""Structured Streaming jobs: ingest, live refresh, scan landing, outcome matching."""
