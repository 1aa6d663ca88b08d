"""Operators for large text corpora, their queries and their SQL."""
