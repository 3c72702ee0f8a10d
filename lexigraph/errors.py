"""Errors of the engine, with an exit code, details and a hint."""

from __future__ import annotations


class EngineError(Exception):
    exit_code = 70

    def __init__(self, message: str, details: dict | None = None, hint: str | None = None):
        super().__init__(message)
        self.details, self.hint = details or {}, hint


class BadRequest(EngineError):
    exit_code = 1


class NotFound(EngineError):
    exit_code = 2


class Conflict(EngineError):
    exit_code = 3


class LanguageGate(EngineError):
    exit_code = 4
