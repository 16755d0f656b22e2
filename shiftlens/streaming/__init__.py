"""Structured Streaming jobs over landing folders."""
