"""Registered queries and their SQL."""

from . import chats, layouts, models, retrieval, texts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
