"""The registered relational queries and their oracles."""
from .queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
