"""Relational operators over typed collections."""
