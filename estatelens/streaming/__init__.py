"""Structured Streaming jobs for the change and analysis feeds."""
