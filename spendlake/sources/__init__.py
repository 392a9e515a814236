"""Readers for landed messages and the table sinks."""
