"""Readers that turn files and tables into the engine schemas."""
