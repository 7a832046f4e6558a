"""Structured Streaming forms of the daily live path."""
