"""Millrace: keyed, event-time analytics declared as Spark plans."""

from millrace.plans.environment import Environment
from millrace.plans.stream import Stream, from_collection, from_source, from_table

__all__ = ["Environment", "Stream", "from_collection", "from_source", "from_table"]
