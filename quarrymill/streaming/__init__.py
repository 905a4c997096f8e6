"""Structured Streaming forms of change handling."""
