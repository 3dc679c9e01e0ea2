"""Readers and writers: PostgreSQL over JDBC, table folders, feeds, the partitioned lake."""
