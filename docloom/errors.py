"""Exceptions, a family for each layer."""

from __future__ import annotations


class DocloomError(Exception):
    """Anything that this package raises on purpose."""


class EngineError(DocloomError):
    """A collection or database was used in a way it can't serve."""


class UnsupportedOperation(EngineError):
    """An operation that is refused by design."""


class DocumentError(DocloomError):
    """A document or value that can't be represented."""


class UnknownTag(DocumentError):
    """A value's type tag is none of the ten."""


class HashMismatch(DocumentError):
    """A document's stored hash differs from its content's."""


class FieldNotFound(DocumentError):
    """An extracted field is not in the document."""


class SegmentError(DocloomError):
    """A segment file is missing or can't be read."""


class LogError(DocloomError):
    """The commit log holds something other than commits."""
