"""Operators for large text corpora: cleaning, deduplication, tokens and shards."""
