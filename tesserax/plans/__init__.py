"""Registered queries, by family."""

from . import bytes as sequences
from . import apps, cursors, images, keyed, space
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "apps", "cursors", "images", "keyed", "space", "sequences"]
