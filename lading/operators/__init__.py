"""Relational derivations over entries: windows, joins, aggregates, sorts and set operations."""
