"""The queries: ``base.QUERIES`` and ``base.SQL`` hold those of both modules."""

from . import catalogue, engine

__all__ = ["catalogue", "engine"]
