"""Relational operators over vectors: search, store, aggregation, classification, clustering."""
