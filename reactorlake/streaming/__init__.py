"""Structured Streaming form of the refresh."""
