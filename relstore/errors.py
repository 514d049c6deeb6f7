"""Errors with a kind and, where a statement's text is at fault, a place in it."""

from __future__ import annotations

from typing import NamedTuple


class Place(NamedTuple):
    offset: int
    line: int
    column: int


class Span(NamedTuple):
    begin: Place
    end: Place


class RelError(Exception):
    """kind: Lexer, Parser, Semantic, Constraint or Execution."""

    def __init__(self, kind: str, message: str, span: Span | None = None):
        where = f"line {span.begin.line}, column {span.begin.column}: " if span else ""
        super().__init__(where + message)
        self.kind, self.message, self.span = kind, message, span

    def __reduce__(self):
        return RelError, (self.kind, self.message, self.span)
