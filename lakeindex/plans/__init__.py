"""Whole commands and the demonstration queries."""
