"""All registered queries of the reference's operators."""

from . import arrays, encodings, files, metadata, storage  # noqa: F401  they register themselves
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
