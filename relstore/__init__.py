"""relstore: a strict, transactional relational engine on PySpark."""

from .engine import Engine
from .errors import RelError
from .result import CommandResult, SelectResult, Stats, format_result
from .types import Column, Schema

__all__ = ["Column", "CommandResult", "Engine", "RelError", "Schema", "SelectResult", "Stats", "format_result"]
