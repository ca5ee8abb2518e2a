"""Structured Streaming jobs over run events and arriving files."""
