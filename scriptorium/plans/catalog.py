"""All core queries, by importing the modules that define them."""

from scriptorium.plans import curation, evaluation, files, formats, texts  # noqa: F401
from scriptorium.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
