"""What can go wrong, under one root."""

from __future__ import annotations


class DedupError(Exception):
    """Root of all errors raised here on purpose."""


class ConfigError(DedupError, ValueError):
    """A setting is unknown, out of range or at odds with another."""


class HashingError(DedupError):
    """A value or index that hash functions cannot take."""


class StorageError(DedupError, OSError):
    """A source or destination cannot be read or written."""


class CheckpointError(DedupError):
    """A stored stage is missing, damaged or of another run."""


class EvaluationError(DedupError, ValueError):
    """An evaluation was asked for that its input cannot give."""


IOError = StorageError  # noqa: A001 - the name that callers of this API know
