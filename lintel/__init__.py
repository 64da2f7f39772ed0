"""Lintel: a Spark-first analytics library for property-register data."""
