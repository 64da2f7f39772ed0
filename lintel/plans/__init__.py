"""Lintel plans."""
