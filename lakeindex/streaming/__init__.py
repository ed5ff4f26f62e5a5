"""Incremental application of the message log."""
