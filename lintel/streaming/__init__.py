"""Lintel streaming."""
