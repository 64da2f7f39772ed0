"""Operators for preparing training text: deduplication, filters, classifiers, mixing and encoding."""
