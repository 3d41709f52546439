"""Structured Streaming, an extension."""
