"""DuckDB counterparts of the registered queries."""
