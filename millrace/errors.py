"""Errors of the engine."""

from __future__ import annotations


class EngineError(Exception):
    """Any error that the engine raises itself."""


class ParseError(EngineError):
    """The text is not of the dialect."""


class AnalysisError(EngineError):
    """The query is of the dialect but means nothing; ``code`` says why."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


class SchemaError(EngineError):
    """Data or a declaration that breaks the catalog's rules."""
