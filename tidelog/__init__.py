"""A versioned key-value analytics engine on PySpark."""

from .operators.store import Store
from .session import build_session

__all__ = ["Store", "build_session"]
