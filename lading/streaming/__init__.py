"""Newly arrived archives as a stream of entries."""
