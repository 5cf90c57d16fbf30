"""Structured Streaming forms of scan statistics (an extension)."""
