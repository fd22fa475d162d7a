"""The document plan over streams."""
