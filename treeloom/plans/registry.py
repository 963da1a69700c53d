"""The registered queries over the reference's operators and their DuckDB counterparts."""

from . import file_oracles, file_queries  # noqa: F401  (they register themselves)
from .oracles import ORACLES
from .queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
