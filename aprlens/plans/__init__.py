"""Whole jobs from archives to result tables."""
