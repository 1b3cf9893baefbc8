"""Structured Streaming form of the incremental score store."""
