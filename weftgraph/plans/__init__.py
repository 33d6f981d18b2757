"""The registered queries with their SQL."""

from . import more  # noqa: F401  registers its queries in the catalogue
from .catalogue import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
