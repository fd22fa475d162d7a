"""Sources of uploads and blocks."""
