"""Reading manifests, archives and tables; writing tables and payloads."""
