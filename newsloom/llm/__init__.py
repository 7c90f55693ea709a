"""Operators and queries for training-data corpora; nothing outside this package imports it."""
