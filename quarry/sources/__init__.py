"""Sources of chunks."""
