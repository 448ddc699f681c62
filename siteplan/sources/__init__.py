"""Readers, response parsers and writers."""
