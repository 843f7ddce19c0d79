"""Parsers, one generator of entries a format."""
