"""Implied-versus-realized rate analytics as lazy Spark DataFrame jobs."""
