"""Lintel operators."""
