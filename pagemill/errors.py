"""Errors of page files and keyed lookups."""


class Error(Exception):
    """Base of this package's errors."""


class InvalidDatabase(Error):
    """A file's header isn't one of a supported database."""


class KeyNotFoundError(Error):
    """A strict search found no row."""


class NoNeighbourPageError(Error):
    """There is no row before or after the one asked for."""
