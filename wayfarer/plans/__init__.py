"""Named queries over the base tables, each with its SQL where SQL can express it."""

from wayfarer.plans import details, ingest, language, read_layer, travel  # noqa: F401  (they register their queries)
from wayfarer.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
