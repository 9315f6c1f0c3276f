"""Relational jobs, each DataFrames in and one DataFrame out, without actions."""
