"""Errors of the dialect and the engine."""

from __future__ import annotations


class ParseError(ValueError):
    """SQL text outside the dialect. ``kind`` is ``unexpected_token``, ``unexpected_eof`` or ``invalid_syntax``."""

    def __init__(self, message: str, kind: str = "invalid_syntax"):
        super().__init__(message)
        self.kind = kind


class EngineError(RuntimeError):
    """A statement that can't be run. ``kind`` is ``already_exists``, ``not_found``, ``invalid_input`` or ``invalid_data``."""

    def __init__(self, message: str, kind: str = "invalid_input"):
        super().__init__(message)
        self.kind = kind


def missing_table(name: str) -> EngineError:
    return EngineError(f"Table '{name}' does not exist", "not_found")


def missing_column(column: str, table: str | None = None) -> EngineError:
    return EngineError(f"Column '{column}' not found" + (f" in table '{table}'" if table else ""), "not_found")
