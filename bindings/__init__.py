"""Test bindings: the data model filled from the given parquet tables, and the registered queries."""
