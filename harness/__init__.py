"""Test tables made from the given parquet files, the registered queries, and their SQL checks."""
