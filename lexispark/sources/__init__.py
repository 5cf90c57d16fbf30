"""Readers that return candidates in one schema, and writers."""
