"""Independent SQL for every registered query, to be run by DuckDB on the same Parquet files."""
