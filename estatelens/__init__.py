"""Dependency-graph and code-quality analytics expressed as Spark jobs."""
