"""Operators for training-data pipelines: filters, deduplication, decontamination, tokens, shards and archives."""
