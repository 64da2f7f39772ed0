"""Lintel functions."""
