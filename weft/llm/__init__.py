"""Operators for text corpora and rankings. Nothing outside this package imports it."""
