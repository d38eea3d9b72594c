"""All queries over the test tables and their SQL."""

from __future__ import annotations

from . import affect, ingest, popularity, streams, text, vectors
from .base import QUERIES, SQL
from .popularity import flagship

__all__ = ["QUERIES", "SQL", "flagship", "affect", "ingest", "popularity", "streams", "text", "vectors"]
