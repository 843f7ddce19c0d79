"""Whole plans: listing, testing, nested listing, extraction, and packing for tests."""
