"""Incremental cleaning of newly landed archives."""
