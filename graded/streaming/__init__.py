"""Structured Streaming variants of the stateless parsers and confusion counts."""
