"""Operators for preparing training data: deduplication, filtering, formatting and mixing of documents."""
