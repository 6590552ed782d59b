"""Queries and their oracles; importing the package registers all of them."""

from . import documents, operations, queries, structure  # isort: skip
from . import streams  # it takes oracles of the others

__all__ = ["documents", "operations", "queries", "streams", "structure"]
