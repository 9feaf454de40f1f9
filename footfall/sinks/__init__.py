"""Keyed writes to Parquet tables, and file and JDBC exports."""
