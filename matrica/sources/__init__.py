"""Reading and writing tables."""

from matrica.sources.tables import read_csv_table, read_table, resolve_column, write_table

__all__ = ["read_csv_table", "read_table", "resolve_column", "write_table"]
