"""Structured Streaming over a folder of page files."""
