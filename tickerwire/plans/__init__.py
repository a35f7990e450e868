"""Query catalog on the driver tables (catalog), derived inputs (derived)
and the DuckDB oracle SQL (oracle)."""
