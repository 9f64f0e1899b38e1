"""Errors of readers and writers."""

from __future__ import annotations


class CodecError(Exception):
    """Any error of a container, header or payload."""


class InvalidData(CodecError):
    pass


class OutOfBounds(InvalidData):
    """A read past the end of the data."""


class Unsupported(CodecError):
    pass
