"""All queries of the engine and their SQL twins."""

from . import estimating, gazetteer, pages, places, placing, records, register, searching, shapes, statistics, streams  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
