"""Parsers, readers and writers."""
