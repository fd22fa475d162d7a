"""Relational operators over blocks, DataFrame to DataFrame."""
