"""Structured Streaming entry points (J-1 .. J-5)."""
