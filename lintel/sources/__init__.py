"""Lintel sources."""
