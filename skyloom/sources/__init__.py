"""Readers that turn raw feeds and files into typed tables, and the table sinks."""
