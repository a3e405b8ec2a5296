"""Writers of sorted, statistics-rich Parquet."""
