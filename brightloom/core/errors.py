"""Errors: what a caller can catch, and the exit code a command ends with."""

from __future__ import annotations


class EngineError(Exception):
    exit_code = 1


class ValidationError(EngineError, ValueError):
    exit_code = 2


class SchemaError(ValidationError):
    pass


class AudioError(ValidationError):
    pass


class ConfigError(ValidationError):
    pass


class TaggingError(ValidationError):
    pass


class AdapterError(EngineError):
    exit_code = 3


class StreamingError(EngineError):
    exit_code = 4
