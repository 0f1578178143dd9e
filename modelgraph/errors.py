"""Errors that carry a stable code."""

from __future__ import annotations


class ModelError(Exception):
    """A definition that can't be accepted, or data that breaks a promise."""

    def __init__(self, code: str, message: str, line: int | None = None):
        self.code, self.message, self.line = code, message, line
        super().__init__(f"{code}: {message}" + (f" (line {line})" if line else ""))


class PinError(ModelError):
    """Published data would break a contract; nothing is published."""
