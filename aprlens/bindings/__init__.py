"""Queries over the shared test tables: adapter views, the query registry and its SQL counterparts."""
