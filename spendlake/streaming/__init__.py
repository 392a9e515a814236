"""Incremental import of a landing folder with Structured Streaming."""
