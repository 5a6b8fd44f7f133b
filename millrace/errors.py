"""Errors by kind: which step failed, and whether trying again may help."""

from __future__ import annotations

from pyspark.errors import AnalysisException, IllegalArgumentException, ParseException, PySparkException


class EngineError(Exception):
    """Base of the engine's own errors."""

    retryable = False


class SourceError(EngineError):
    """An input can't be read."""


class SourceUnavailable(SourceError):
    """An input or its database doesn't answer now."""

    retryable = True


class SinkError(EngineError):
    """An output can't be written; whole versions are, or nothing is."""

    retryable = True


class StatementError(EngineError):
    """A statement isn't valid or may not run; the same statement never will."""


class IndexMissing(EngineError):
    """No readable version of an index; build it first."""


class ModelError(EngineError):
    """An encoder, reranker or extractor that was passed in failed."""

    retryable = True


def retryable(error: BaseException) -> bool:
    """Whether the same call may succeed later: an error's own flag, never for statements that Spark can't analyse, and for lost connections and time limits."""
    if isinstance(error, EngineError):
        return error.retryable
    if isinstance(error, (AnalysisException, ParseException, IllegalArgumentException)):
        return False
    return isinstance(error, (ConnectionError, TimeoutError, PySparkException))
