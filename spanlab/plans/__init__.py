"""Plans: the shared lineage, the query registry and the DuckDB oracle."""
