"""The library's operators bound to the given tables, each with SQL to check it."""

from .registry import REGISTRY
from . import weekly, features, screens, sources, reports, streams  # noqa: E402,F401

__all__ = ["REGISTRY"]
