"""Composite jobs: panels, feature tables, live scoring, user-level queries."""
