"""Errors of the engine, by the part that raises them, and the exit codes of the command line."""

from __future__ import annotations


class EngineError(Exception):
    """Any error of the engine."""

    exit_code = 1


class ConfigError(EngineError):
    exit_code = 2


class SourceError(EngineError):
    """The message log can't be read."""

    exit_code = 3


class CatalogError(EngineError):
    exit_code = 4


class CommitConflict(CatalogError):
    """Another writer committed first."""


class StorageError(EngineError):
    exit_code = 5


class LedgerError(EngineError):
    """The ledger holds something that isn't an entry."""

    exit_code = 6


class BufferError_(EngineError):
    """Rows don't fit the table that they are appended to."""


class ReadStateError(EngineError):
    """A scan can't be answered, for one because it asks for rows ahead of the table."""


class DecodeError(EngineError):
    """A message's bytes aren't what its format says."""


class SchemaError(EngineError):
    """A schema change that the table can't take."""


INTERRUPTED = 130
