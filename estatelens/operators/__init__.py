"""Graph, join, aggregate and ordering operators over the engine tables."""
